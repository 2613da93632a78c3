"""Personal data: fixed forms, and bootstrapped contextual extraction of more, in DataFrame operations alone.

Fixed forms (email, ip, card, phone) are found by patterns; their spans are the seeds. The words that
stand before them induce lexical patterns ("the word before is w"). Patterns and instances make a
graph, scored in rounds: a pattern's score is the mass of its instances over all occurrences of its
word in the corpus, an instance's score is its best promoted pattern's. Patterns of high confidence
(score and number of different instances) are promoted, and the identifier-like tokens (with a digit
or an at sign) that follow them are found as kind "context"; they count as instances in the next round.
Scores only rise; rounds end when no pattern was promoted and none could be with its instances at score 1.

A pattern's score can't exceed all its identifier-like instances over its occurrences, so words that
precede anything, such as articles, are pruned before the first round. Words that precede no seed stay:
they may be promoted by what others found.

Edge cases: null and empty texts have no spans; matches that fail their check (parts of an ip, digits
or Luhn sum of a card, digits of a phone) are dropped; spans of different kinds may overlap and all
stay in the result, and masking merges them; a very long text takes time in proportion to its length and
the logarithm of its matches; repeated rows and copies get equal results, and copies don't raise
the number of different instances; null ids stay null; an empty table gives an empty result; other
columns are ignored, or kept by mask().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import cut

KINDS = ("email", "ip", "card", "phone", "context")

# The contract's forms. Possessive repeats and the looks behind keep matches as they are and the time
# linear: a match can only start where its first run starts, or where the last match ended.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Of a token: the key and what parts it from the value, and the marks after the value.
_KEY, _TRAIL = r"""^([^=:0-9@]++[=:]++["']?+)""", r"""(?<![.,;:!?)"'])[.,;:!?)"']++$"""
#: White-space tokens with a digit or an at sign.
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

LEAST_SCORE, LEAST_INSTANCES = 0.5, 3
#: The rise of all scores in a round below which they count as settled.
SETTLED = 1e-6
#: Patterns that are sent to every task to count their words; beyond it, words are counted first and joined.
BROADCAST_PATTERNS = 200_000


def _luhn(digits: str) -> str:
    digit = f"(ascii(substr({digits}, length({digits}) - i + 1, 1)) - 48)"
    return f"aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 1, {digit}, {digit} * 2 - if({digit} > 4, 9, 0))) % 10 = 0"


def _let(name: str, value: str, body: str) -> str:
    """body with value worked out once: a column that a lambda names would be worked out for each element."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Values that are put together one after another; more are by places of 16, since that copies what came before.
_FEW = 64


def _running(values: str, highest: bool = False) -> str:
    """The sum, or the highest, of all values up to each one: of 16 places, then of 16 times as many, and so on."""
    many = "v"
    for d in (16**k for k in range(7)):
        before = [f"get(a, i - {j * d})" for j in range(1, 16)]
        taken = f"greatest(x, {', '.join(before)})" if highest else "x + " + " + ".join(f"coalesce({g}, 0)" for g in before)
        many = _let("a", many, f"if(size(a) > {d}, transform(a, (x, i) -> {taken}), a)")
    last = "coalesce(get(s, size(s) - 1), 0)"
    few = f"aggregate(v, cast(array() as array<int>), (s, x) -> concat(s, array({f'greatest({last}, x)' if highest else f'{last} + x'})))"
    return _let("v", values, f"if(size(v) <= {_FEW}, {few}, {many})")


def _starts(pieces: str, matches: str) -> str:
    """Where each match starts: what stands before it, summed."""
    ends = _running(f"zip_with(slice({pieces}, 1, size({matches})), {matches}, (p, m) -> length(p) + length(m))")
    return f"zip_with({ends}, {matches}, (e, m) -> e - length(m))"


#: Characters of a text's blocks. A piece is cut from the blocks it lies in, since a cut from a whole text passes all before it.
_BLOCK = 1024
_BLOCKS = f"regexp_extract_all(text, '(?s).{{1,{_BLOCK}}}+', 0)"


def _between(start: str, end: str) -> str:
    """The characters [start, end) of the text in blocks b."""
    first, last = f"cast(({start}) div {_BLOCK} as int)", f"cast(greatest(({end}) - 1, {start}) div {_BLOCK} as int)"
    return f"substr(concat_ws('', slice(b, {first} + 1, {last} - {first} + 1)), ({start}) % {_BLOCK} + 1, ({end}) - ({start}))"


_VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(p as decimal(38,0)), 256) <= 255)",
    "card": "length(regexp_replace(x.m, '[^0-9]', '')) between 12 and 19 and " + _luhn("regexp_replace(x.m, '[^0-9]', '')"),
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) between 9 and 15",
}


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPAN = "array<struct<start:int,ord:int,end:int,kind:string,form:string>>"


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with the column spans: (start, ord, end, kind, form) of the fixed forms, by start, then kind."""
    digits = "text rlike '[0-9]'"
    gates = {"email": "contains(text, '@')", "ip": f"contains(text, '.') and {digits}", "card": digits, "phone": "contains(text, '+')"}
    kept = docs.columns
    out = docs
    for kind, pattern in (("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        out = out.withColumn(f"_{kind}", F.expr(f"case when {gates[kind]} then regexp_extract_all(text, {_quoted(pattern)}, 0) end"))
    for kind, pattern in (("email", _EMAIL), ("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        m = f"_{kind}"
        out = out.withColumn(f"{m}p", F.expr(f"case when size({m}) > 0 then split(text, {_quoted(pattern)}, -1) end"))
    for n, kind in enumerate(KINDS[:4]):
        m = f"_{kind}"
        found = f"transform(filter(arrays_zip({m} as m, {_starts(m + 'p', m)} as at), x -> {_VALID[kind]}), x -> named_struct('start', x.at, 'ord', {n}, 'end', x.at + length(x.m), 'kind', '{kind}', 'form', x.m))"
        found = found.replace(f"arrays_zip({m} as m, {_starts(m + 'p', m)} as at)", f"zip_with({m}, {_starts(m + 'p', m)}, (a, b) -> named_struct('m', a, 'at', b))")
        out = out.withColumn(f"{m}s", F.expr(f"case when {m}p is not null then cast({found} as {_SPAN}) else cast(array() as {_SPAN}) end"))
    every = "concat(" + ", ".join(f"_{k}s" for k in KINDS[:4]) + ")"
    return out.select(*kept, F.expr(f"case when size({every}) > 1 then array_sort({every}) else {every} end").alias("spans"))


#: The word before a span; a separator that stands alone is taken with the word before it.
def _left(before: str) -> str:
    return f"lower(regexp_replace(regexp_extract(right({before}, 64), '([^\\\\s]+(?:[ \\\\t]+[=:#]+)?)[\\\\s\"\\'(]*$', 1), '\\\\s', ''))"


def contexts(spanned: DataFrame) -> DataFrame:
    """key (of the text), doc_id, spans, seeds (left, form) of the fixed forms, and tokens (start, end,
    left, form) of the other identifier-like tokens, for every row."""
    before = _between("greatest(0, s.start - 64)", "s.start")
    seeds = _let("b", _BLOCKS, f"transform(spans, s -> named_struct('left', {_left(before)}, 'form', s.form))")
    out = spanned.withColumn("seeds", F.expr(f"case when size(spans) > 0 then {seeds} else array() end"))
    out = out.withColumn("_t", F.expr(f"case when text rlike '[0-9@]' then regexp_extract_all(text, {_quoted(_TOKEN)}, 0) end"))
    out = out.withColumn("_p", F.expr(f"case when size(_t) > 0 then split(text, {_quoted(_TOKEN)}, -1) end"))
    # Tokens and spans in one order, a span before a token at its start. A token is in a span if one before ends
    # after its start, or the next of all starts before its end: tokens don't overlap.
    tokens = f"zip_with(zip_with(_t, {_starts('_p', '_t')}, (m, a) -> named_struct('at', a, 'o', 1, 'e', a + length(m), 'm', m)), slice(_p, 1, size(_t)), (x, p) -> named_struct('at', x.at, 'o', x.o, 'e', x.e, 'm', x.m, 'p', p))"
    spans = "transform(spans, s -> named_struct('at', s.start, 'o', 0, 'e', s.end, 'm', '', 'p', ''))"
    out = out.withColumn("_z", F.expr(f"case when _p is not null then {tokens} end"))
    inside = "(get(h, i) > x.at or coalesce(get(e, i + 1).o = 0 and get(e, i + 1).at < x.e, false))"
    outside = _let("h", _running("transform(e, t -> if(t.o = 0, t.e, 0))", highest=True), f"filter(e, (x, i) -> x.o = 1 and not {inside})")
    outside = _let("e", f"sort_array(concat({spans}, _z))", outside)
    out = out.withColumn("_z", F.expr(f"case when _z is null or size(spans) = 0 then _z else {outside} end"))
    bare = f"regexp_replace(x.m, {_quoted(_TRAIL)}, '')"
    named = f"transform(_z, x -> named_struct('at', x.at, 'm', {bare}, 'k', regexp_extract(x.m, {_quoted(_KEY)}, 1), 'p', x.p))"
    made = f"transform({named}, x -> named_struct('at', x.at, 'k', x.k, 'v', substr(x.m, length(x.k) + 1), 'p', x.p))"
    tokens = (
        f"transform(filter({made}, y -> length(y.v) >= 4), y -> named_struct('start', y.at + length(y.k), 'end', y.at + length(y.k) + length(y.v), "
        f"'left', case when y.k <> '' then lower(regexp_replace(y.k, {_quoted('["' + "']$")}, '')) else {_left('y.p')} end, 'form', y.v))"
    )
    return out.select(
        F.md5(F.col("text").cast("binary")).alias("key"), "doc_id", "spans", "seeds", F.expr(f"case when _z is not null then {tokens} end").alias("tokens"),
    )


def _words(docs: DataFrame) -> DataFrame:
    """Each word of the corpus as patterns see it: lower-cased, lone separators with the word before, of key=value the key."""
    glued = F.expr("case when text rlike '[ \\\\t][=:#]' then regexp_replace(text, '[ \\\\t]+([=:#]+)', '$1') else text end")
    word = F.explode(F.split(F.lower(glued), r"[\x20\x09-\x0D]+"))
    return docs.select(word.alias("w")).select(F.expr("case when contains(w, '=') or contains(w, ':') then regexp_replace(w, '^([^=:0-9@]+[=:]+)[\"\\']?.+$', '$1') else w end").alias("left"))


def learn(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """The promoted patterns (left, score), or None if there are none."""
    seeds = found.select(F.explode("seeds").alias("x")).select("x.left", "x.form").where("left <> ''")
    tokens = found.select(F.explode("tokens").alias("x")).select("x.left", "x.form").where("left <> ''")
    forms = seeds.select("form").distinct().withColumn("seed", F.lit(1.0))
    edges = seeds.unionByName(tokens).groupBy("left", "form").agg(F.count("*").alias("n"))
    edges = cut(edges.join(forms, "form", "left").withColumn("seed", F.coalesce("seed", F.lit(0.0))), "edges")
    # Only patterns with enough different instances can be promoted, and the first only by seeds.
    heads = edges.groupBy("left").agg(F.count("*").alias("forms"), F.sum("n").alias("mass"), F.sum("seed").alias("seeds"))
    heads = cut(heads.where(f"forms >= {LEAST_INSTANCES}").select("left", "mass", "seeds"), "heads")
    n, first = heads.agg(F.count("*"), F.max("seeds")).first()
    if not n or first < LEAST_INSTANCES:
        return None
    heads = heads.drop("seeds")
    if n <= BROADCAST_PATTERNS:
        counts = _words(docs).join(F.broadcast(heads.select("left")), "left", "left_semi").groupBy("left").count()
    else:
        counts = _words(docs).groupBy("left").count().join(heads.select("left"), "left", "left_semi")
    heads = cut(heads.join(counts.withColumnRenamed("count", "occurs"), "left").where(F.col("mass") >= LEAST_SCORE * F.col("occurs")), "likely")
    edges = cut(edges.join(heads.select("left", "occurs"), "left"), "graph")
    if edges.isEmpty():
        return None
    scores = edges.select("form", "seed").distinct().withColumnRenamed("seed", "score")
    before, mass = 0, 0.0
    while True:
        held = edges.join(scores, "form")
        patterns = held.groupBy("left").agg(
            (F.sum(F.col("n") * F.col("score")) / F.first("occurs")).alias("pattern"), F.sum(F.when(F.col("score") >= LEAST_SCORE, 1).otherwise(0)).alias("instances"),
            (F.sum(F.when(F.col("score") > 0, F.col("n")).otherwise(0)) / F.first("occurs")).alias("most"),
        )
        likely = cut(patterns.where(f"most >= {LEAST_SCORE} and instances >= {LEAST_INSTANCES}"), "promoted")
        promoted = likely.where(f"pattern >= {LEAST_SCORE}").select("left", "pattern")
        could, n, now = likely.agg(F.count("*"), F.count_if(F.col("pattern") >= LEAST_SCORE), F.coalesce(F.sum("pattern"), F.lit(0.0))).first()
        if n == before and (could == n or now - mass < SETTLED):
            break
        before, mass = n, now
        best = edges.join(promoted, "left", "left").groupBy("form").agg(F.max("seed").alias("seed"), F.max("pattern").alias("best"))
        scores = cut(best.select("form", F.greatest("seed", F.least(F.lit(1.0), F.coalesce("best", F.lit(0.0)))).alias("score")), "scores")
    return None if promoted.isEmpty() else promoted.withColumnRenamed("pattern", "score")


def _text_of(spans: str | Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _hits(found: DataFrame, promoted: DataFrame) -> DataFrame:
    """key and more: the contextual spans of each text that has any."""
    tokens = found.select("key", F.explode("tokens").alias("x")).select("key", "x.start", "x.end", "x.left", "x.form")
    span = F.struct("start", F.lit(4).alias("ord"), "end", F.lit("context").alias("kind"), "form")
    hits = tokens.join(promoted, "left", "left_semi").distinct()
    return hits.groupBy("key").agg(F.array_sort(F.collect_list(span)).cast(_SPAN).alias("more"))  # of one text


def found_spans(docs: DataFrame) -> DataFrame:
    """key, doc_id, spans (fixed forms) and more (contextual) of every row of docs (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = cut(contexts(with_spans(docs)), "contexts")
    promoted = learn(docs, found)
    none = F.array().cast(_SPAN)
    if promoted is None:
        return found.select("key", "doc_id", "spans", none.alias("more"))
    hits = _hits(found, promoted)
    return found.join(hits, "key", "left").select("key", "doc_id", "spans", F.coalesce("more", none).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row of docs (doc_id, text)."""
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.when(F.size("more") > 0, F.array_sort(F.concat("spans", "more"))).otherwise(F.col("spans"))
    return found_spans(docs).select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(_text_of("spans"), 256).alias("base_sha256"), _text_of(every).alias("spans"), F.size("more").cast("long").alias("n_context"))


def mask(docs: DataFrame) -> DataFrame:
    """docs with each found span of the text replaced by its kind in brackets, as [EMAIL]; spans that overlap become one."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = cut(contexts(with_spans(plain)).drop("spans"), "contexts")
    promoted = learn(plain, found)
    kept = docs.columns
    rows = docs.withColumnRenamed("spans", "_own_spans") if "spans" in kept else docs
    rows = with_spans(rows).withColumnRenamed("spans", "_spans")
    if promoted is not None:
        rows = rows.withColumn("_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        rows = rows.join(_hits(found, promoted).select(F.col("key").alias("_key"), F.col("more").alias("_more")), "_key", "left")
        rows = rows.withColumn("_spans", F.when(F.size("_more") > 0, F.concat("_spans", "_more")).otherwise(F.col("_spans")))
    # Merged: a span that starts before all before it have ended goes on with them, under the first's kind.
    # Then the text is put together from what lies between.
    firsts = "filter(transform(o, (x, i) -> named_struct('i', i, 's', x.start, 'k', x.kind)), f -> f.i = 0 or get(h, f.i - 1) <= f.s)"
    merged = "transform(f, (x, j) -> named_struct('s', x.s, 'e', get(h, coalesce(get(f, j + 1).i, size(o)) - 1), 'k', upper(x.k)))"
    parts = f"transform(m, (x, i) -> concat({_between('coalesce(get(m, i - 1).e, 0)', 'x.s')}, '[', x.k, ']'))"
    masked = f"concat(concat_ws('', {parts}), {_between('element_at(m, -1).e', 'length(text)')})"
    for name, value in (("b", _BLOCKS), ("m", merged), ("f", firsts), ("h", _running("transform(o, t -> t.end)", highest=True)), ("o", "sort_array(_spans)")):
        masked = _let(name, value, masked)
    text = F.expr(f"case when size(_spans) > 0 then {masked} else text end")
    return rows.select(*(text.alias("text") if c == "text" else F.col("_own_spans").alias("spans") if c == "spans" else F.col(c) for c in kept))

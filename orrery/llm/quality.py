"""Quality rules under weak supervision.

Each rule votes keep (1), reject (0) or abstains (-1) on a document. Votes are counted by vote
pattern in Spark (the number of patterns is bounded by the rules, not by the documents), and
expectation-maximisation on those counts estimates how often each rule rejects under each hidden
class: one class is the good documents, the others are kinds of bad ones. Rules are independent within
a kind, not among all bad documents, since junk of one sort fails the same few rules together. There is
a kind for each rule to start with, in which that rule mostly rejects; kinds that no documents need
fade out. So a rule that now and then rejects alone, where its kind fails other rules too, is outvoted.
Abstaining carries no evidence. A document's posterior probability of being good is then an expression
over literals, so nothing grows with the data.

Edge cases: null or empty text has no words, all counts 0, base_failed true and kept false; a rule
without evidence abstains; repeated rows and ties get equal results, row by row; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import arrow_map, cut

#: Frequent function words of the four languages of the corpus (fixed values).
STOP_WORDS = (
    "the of and to in is it that was for on are as with be by this from at or an not "
    "der die das und ist von zu den mit sich des auf für nicht ein eine dem im als auch "
    "de la le et les des un une du en que qui dans pour par sur au pas est avec "
    "el los las una por con se del su para al lo como más o no y"
).split()

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))

FEATURES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_ended long, n_upper long, n_lower long, n_stop long, n_same_next long, n_marks long"
)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of width words found twice or more in words, all occurrences counted."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    size = len(ids)
    if size + n < 1 << 12:  # five ids of 12 bits fit one number
        code = at[:n].copy()
        for k in range(1, width):
            code = (code << 12) | at[k : k + n]
    else:  # dense numbers for windows of two, then four, then five words: exact at any length
        two = np.unique(at[:-1] * size + at[1:], return_inverse=True)[1]
        m = int(two.max()) + 1
        four = np.unique(two[:-2] * m + two[2:], return_inverse=True)[1]
        code = four[:n] * size + at[width - 1 :]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(len(words) + 1, np.int64)
    np.add.at(hit, np.flatnonzero(again), 1)
    np.subtract.at(hit, np.flatnonzero(again) + width, 1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def features(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACES)]
    ended = sum(x.rstrip(_SPACES)[-1:] in (b".", b"!", b"?", b":", b'"', b")") for x in lines)
    upper, lower = len(raw) - len(raw.translate(None, _UPPER)), len(raw) - len(raw.translate(None, _LOWER))
    low = [w.lower().rstrip(b".,;:!?") for w in words]
    return (
        len(words),
        len((text or "").translate(_DROP_SPACES)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        ended,
        upper,
        lower,
        sum(w in _STOP for w in low),
        sum(a == b for a, b in zip(words, words[1:])),
        raw.count(b"!!") + raw.count(b"??"),
    )


_DROP_SPACES = {i: None for i in _SPACES}


def _batch(b: pa.RecordBatch) -> pa.RecordBatch:
    found = [features(t) for t in b.column("text").to_pylist()]
    cols = [b.column("doc_id"), *(pa.array([r[k] for r in found], pa.int64()) for k in range(12))]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in FEATURES.split(", ")])


def _vote(reject: Column, keep: Column) -> Column:
    return F.when(reject, 0).when(keep, 1).otherwise(-1)


def rules(within: str = "") -> dict[str, Column]:
    """Name and vote of each rule, on the columns of FEATURES (fields of the column within)."""
    c = lambda name: F.col(within + name)
    n = c("n_words")
    letters = c("n_upper") + c("n_lower")
    some = n >= 10
    return {
        "symbols": _vote((10 * c("n_symbols") > n) | (some & (33 * c("n_symbols") > c("word_chars"))), some & (100 * c("n_symbols") <= n)),
        "capitals": _vote((letters >= 20) & (2 * c("n_upper") > letters), (letters >= 20) & (4 * c("n_upper") <= letters)),
        "repeated_windows": _vote(100 * c("n_repeat_words") > 10 * n, some & (100 * c("n_repeat_words") <= 5 * n)),
        "repeated_lines": _vote((c("n_dup_lines") >= 2) & (10 * c("n_dup_lines") > 3 * c("n_lines")), (c("n_lines") >= 2) & (10 * c("n_dup_lines") <= c("n_lines"))),
        "stuttering": _vote(some & (5 * c("n_same_next") > n), some & (20 * c("n_same_next") <= n)),
        "function_words": _vote((n >= 30) & (100 * c("n_stop") < 2 * n), some & (100 * c("n_stop") >= 8 * n)),
        "shouting": _vote(some & (10 * c("n_marks") > n), some & (c("n_marks") * 100 <= n)),
        "word_length": _vote(some & ((c("word_chars") < 3 * n) | (c("word_chars") > 9 * n)), some & (c("word_chars") >= 4 * n) & (c("word_chars") <= 8 * n)),
        "line_ends": _vote((c("n_lines") >= 3) & (10 * c("n_ended") < 5 * c("n_lines")), (c("n_lines") >= 2) & (10 * c("n_ended") >= 9 * c("n_lines"))),
    }


#: Votes that a rule is taken to have had before any was seen, (reject, keep): on good documents, and on bad ones of a kind.
GOOD_PRIOR, BAD_PRIOR = (1, 19), (1, 3)
#: Documents that are taken to have been seen before any was: good ones, and bad ones of all kinds.
SHARE_PRIOR = (4, 1)


def fit_kinds(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """EM for a label model on vote patterns and their counts: the share of each class, the good one last,
    and rejects[class, rule], the chance that a rule which votes on a document of the class rejects it.

    The priors are proper, so no rate is 0 or 1 and none needs a bound. Kinds of bad documents that hold
    less than one document go, but for the largest.
    """
    rejects = np.full((n_rules + 1, n_rules), 0.05)
    rejects[np.arange(n_rules), np.arange(n_rules)] = 0.8
    rejects[-1] = 0.01
    priors = np.array([BAD_PRIOR] * n_rules + [GOOD_PRIOR], float)
    ahead = np.array([SHARE_PRIOR[1] / n_rules] * n_rules + [SHARE_PRIOR[0]])
    shares = ahead / ahead.sum()
    if not patterns:
        return shares, rejects
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    no, yes = (votes == 0).astype(float), (votes == 1).astype(float)
    for _ in range(rounds):
        likely = np.log(shares) + no @ np.log(rejects.T) + yes @ np.log(1 - rejects.T)
        held = np.exp(likely - likely.max(1, keepdims=True))
        held *= (n / held.sum(1))[:, None]
        shares = (held.sum(0) + ahead) / (n.sum() + ahead.sum())
        new = (held.T @ no + priors[:, :1]) / (held.T @ (no + yes) + priors.sum(1, keepdims=True))
        moved, rejects = np.abs(new - rejects).max(), new
        if moved < 1e-9:
            break
    stays = held.sum(0) >= 1
    stays[-1] = stays[np.argmax(shares[:-1])] = True
    return shares[stays] / shares[stays].sum(), rejects[stays]


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, np.ndarray]:
    """fit_kinds() in two classes: the share of good documents, and rejects[class, rule] of bad (0) and good (1) ones."""
    shares, rejects = fit_kinds(patterns, n_rules)
    return float(shares[-1]), np.stack([shares[:-1] @ rejects[:-1] / shares[:-1].sum(), rejects[-1]])


def learn(voted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """fit_kinds() on the votes of a table with n_words and the vote_ columns."""
    cols = [f"vote_{k}" for k in rules()]
    # At most 3 ** rules rows, whatever the corpus; one counted row for each pattern of votes.
    counts = voted.where("n_words > 0").groupBy(*cols).count().orderBy(*cols).collect()
    return fit_kinds([(tuple(r[c] for c in cols), r["count"]) for r in counts], len(cols))


def _posterior(votes: list[Column], shares: np.ndarray, rejects: np.ndarray) -> Column:
    """1 / (1 + the sum over the kinds of bad documents of how much likelier the votes are under them)."""
    against = F.lit(0.0)
    for share, kind in zip(shares[:-1], rejects[:-1]):
        log = F.lit(math.log(share / shares[-1]))
        for vote, bad, good in zip(votes, kind, rejects[-1]):
            log = log + F.when(vote == 0, math.log(bad / good)).when(vote == 1, math.log((1 - bad) / (1 - good))).otherwise(0.0)
        against = against + F.exp(log)
    return 1 / (1 + against)


def _failed(within: str = "") -> Column:
    """Rejected outright: hardly any words, or mostly repeated ones."""
    n = F.col(within + "n_words")
    return (n < 10) | (100 * F.col(within + "n_repeat_words") > 20 * n)


def _voted(docs: DataFrame) -> DataFrame:
    feats = arrow_map(docs.select("doc_id", "text"), _batch, FEATURES)
    return cut(feats.select("*", *(v.cast("int").alias(f"vote_{k}") for k, v in rules().items())), "votes")


def quality_scores(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, the votes, posterior and kept of every row of docs (doc_id, text)."""
    voted = _voted(docs)
    cols = [f"vote_{k}" for k in rules()]
    posterior = _posterior([F.col(c) for c in cols], *learn(voted))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _failed().alias("base_failed"), posterior.alias("posterior"), *cols,
        (~_failed() & (posterior >= threshold)).alias("kept"),
    )


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality_scores() keeps, with all their columns. Rows are judged where they
    stand, in a second pass: texts are neither shuffled nor matched by id."""
    posterior = _posterior(list(rules("_quality.").values()), *learn(_voted(docs)))
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = _batch(b)
        return pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays([found.column(n) for n in names], names)], [*b.schema.names, "_quality"])

    fields = ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in FEATURES.split(", "))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"_quality struct<{fields}>").fields])
    return arrow_map(docs, run, schema).where(~_failed("_quality.") & (posterior >= threshold)).drop("_quality")

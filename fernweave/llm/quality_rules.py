"""Quality rules as a learned decision list over statistics of the text.

Sequential covering: a rule is a conjunction of thresholds on named statistics. It is grown
on two thirds of the labelled rows, a condition at a time by information gain, then pruned
from its end on the other third, for each third in turn; the rows that the best rule covers
leave, and the next is grown from the rest, until none is precise enough. The list becomes one ordered CASE expression of
Spark, whose first true rule names the reason to reject a document.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fernweave.llm.text import NON_SPACE, Words, blocks, gram_hashes, mix, raw, span_hashes, words

#: Most labelled rows that the list is learned from.
LABELLED = 20_000
#: Words in a window, thresholds tried for a statistic, conditions in a rule, rules in the list.
WINDOW, THRESHOLDS, CONDITIONS, RULES = 8, 64, 4, 16
#: Share of a rule's rows in the pruning third that must be bad, and rows there at least.
PRECISE, COVERED = 0.9, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_again", "n_distinct", "n_ended", "longest"]

_KINDS = {"n_symbols": b"#*$%&|<>", "n_upper": bytes(range(0x41, 0x5B)), "n_digits": bytes(range(0x30, 0x3A)), "n_marks": b"!?{}[]()=/\\_~^@+\"'"}
_IN_LINE = np.ones(256, dtype=bool)
_IN_LINE[0x0A] = False


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_TABLES = {name: _table(members) for name, members in _KINDS.items()}
_CHARS = np.array([b & 0xC0 != 0x80 for b in range(256)])
_STOPS = _table(b".!?:;\"'")


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of flags over the stretches that off marks."""
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[off[1:]] - total[off[:-1]]


def _earlier(keys: np.ndarray) -> np.ndarray:
    """Which entries equal one before them."""
    _, first = np.unique(keys, return_index=True)
    again = np.ones(len(keys), dtype=bool)
    again[first] = False
    return again


def _repeat_words(h: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Which words stand in a window of their row that the row has twice or more."""
    inside = np.zeros(len(h) + 1, dtype=np.int64)
    grams = gram_hashes(h, window)
    at = np.flatnonzero(row[: len(grams)] == row[window - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
    _, of, n = np.unique(mix(grams[at] ^ mix(row[at].astype(np.uint64))), return_inverse=True, return_counts=True)
    twice = at[n[of] > 1] if len(at) else at
    np.add.at(inside, twice, 1)
    np.add.at(inside, twice + window, -1)
    return np.cumsum(inside[:-1]) > 0


def statistics(texts: pa.Array, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The COUNTS of each text, by name. Words and lines are told apart by 64-bit hashes."""
    data, off = raw(texts)
    w: Words = words(texts, NON_SPACE, lower=False)
    h, n_words = w.hashes(), np.diff(w.edges)
    row = np.repeat(np.arange(len(texts)), n_words)
    out = {name: _sums(table[data], off) for name, table in _TABLES.items()}
    out["n_words"] = n_words
    out["n_chars"] = _sums(_CHARS[data], off)
    out["word_chars"] = _sums(_CHARS[data] & NON_SPACE[data], off)
    own = mix(h ^ mix(row.astype(np.uint64)))
    out["n_distinct"] = n_words - _sums(_earlier(own), w.edges)
    beside = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])) if len(h) else np.zeros(0, bool)
    out["n_again"] = _sums(beside, w.edges)
    out["n_ended"] = _sums(_STOPS[w.buffer[w.ends - 1]] if len(h) else np.zeros(0, bool), w.edges)
    out["n_repeat_words"] = _sums(_repeat_words(h, row, window), w.edges)
    sizes = np.append(w.ends - w.starts, 0)
    out["longest"] = np.where(n_words > 0, np.maximum.reduceat(sizes, np.minimum(w.edges[:-1], len(sizes) - 1)), 0) if len(texts) else n_words
    lines = words(texts, _IN_LINE, lower=False)
    full = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    of = np.repeat(np.arange(len(texts)), np.diff(lines.edges))
    same = np.zeros(len(full), dtype=bool)
    keys = span_hashes(lines.buffer, lines.starts[full], lines.ends[full])
    same[full] = _earlier(mix(keys ^ mix(of[full].astype(np.uint64))))
    out["n_lines"], out["n_dup_lines"] = _sums(full, lines.edges), _sums(same, lines.edges)
    return out


#: What rules may ask for, as Spark expressions of the counts.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "longest_word_bytes": "cast(longest as double)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "digits_a_char": "n_digits / greatest(n_chars, 1)",
    "upper_a_char": "n_upper / greatest(n_chars, 1)",
    "space_a_char": "(n_chars - word_chars) / greatest(n_chars, 1)",
    "dup_lines_a_line": "n_dup_lines / greatest(n_lines, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "repeats_a_word": "n_repeat_words / greatest(n_words, 1)",
    "again_a_word": "n_again / greatest(n_words, 1)",
    "distinct_a_word": "n_distinct / greatest(n_words, 1)",
    "ended_a_word": "n_ended / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    """feature >= bound where `above`, else feature < bound."""

    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        x = F.expr(FEATURES[self.feature])
        return x >= self.bound if self.above else x < self.bound

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(FEATURES).index(self.feature)]
        return value >= self.bound if self.above else value < self.bound

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule]) if rule else np.ones(len(x), dtype=bool)


def grow(x: np.ndarray, bad: np.ndarray, conditions: int = CONDITIONS) -> Rule:
    """Conditions by most gain, bad rows kept times the bits that the rule's precision wins,
    until it covers no good row or none gains."""
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < conditions and (~bad[inside]).any():
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, most = None, 1e-9
        for k, name in enumerate(FEATURES):
            values = x[inside, k]
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            cuts = np.flatnonzero(ranked[1:] > ranked[:-1]) + 1
            if len(cuts) > THRESHOLDS:
                cuts = cuts[np.linspace(0, len(cuts) - 1, THRESHOLDS).astype(int)]
            below = np.append(0, np.cumsum(bad[inside][order]))[cuts]
            for above in (True, False):
                tp = p - below if above else below
                size = len(values) - cuts if above else cuts
                gain = tp * (np.log2(np.maximum(tp, 1e-9) / size) - np.log2(p / (p + n))) if p else np.zeros(len(cuts))
                if len(cuts) and gain.max() > most:
                    i = int(gain.argmax())
                    most, best = float(gain[i]), Condition(name, above, float((ranked[cuts[i] - 1] + ranked[cuts[i]]) / 2))
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The beginning of the rule with the highest (bad - good) / (bad + good) of what it
    covers, of equals the shortest; without conditions that a later one implies."""

    def worth(r: Rule) -> float:
        own = bad[covered(r, x)]
        return (2 * own.sum() - len(own)) / len(own) if len(own) else -1.0

    best = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())
    return tuple(c for i, c in enumerate(best) if not any((d.feature, d.above) == (c.feature, c.above) for d in best[i + 1 :]))


def learn_list(x: np.ndarray, bad: np.ndarray, precise: float = PRECISE, rules: int = RULES) -> list[Rule]:
    """x: rows of FEATURES; bad: which to reject. Each third of the rows prunes a rule of the
    others; of those that are precise on their third, and cover enough rows there, the one that
    covers most bad rows joins the list. None: the list ends; no bad rows: no rules."""
    found: list[Rule] = []
    third = np.arange(len(x)) % 3
    left = np.ones(len(x), dtype=bool)
    while len(found) < rules and bad[left].any():
        offered = []
        for k in range(3):
            ours, theirs = left & (third != k), left & (third == k)
            rule = prune(grow(x[ours], bad[ours]), x[theirs], bad[theirs])
            own, every = (bad[rows][covered(rule, x[rows])] for rows in (theirs, left))
            if rule and len(own) >= COVERED and min(own.mean(), every.mean()) >= precise:
                offered.append((int(every.sum()), rule))
        if not offered:
            break
        found.append(max(offered, key=lambda r: (r[0], -len(r[1])))[1])
        left &= ~covered(found[-1], x)
    return found


def rejected_by(rules: list[Rule]) -> Column:
    """The text of the first rule that holds, null if none: one CASE of Spark, in order."""
    if not rules:
        return F.lit(None).cast("string")
    out = None
    for rule in rules:
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        name = F.lit(" and ".join(map(str, rule)))
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return out


def with_statistics(df: DataFrame, keep: list[str], text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The columns `keep` of df and the COUNTS of its texts; null texts count as empty."""
    own = df.select(*keep, F.col(text_col).alias("_text"))
    names = [f"_{c}" for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, texts in blocks(batch, "_text"):
                found = statistics(texts, window)
                columns = [batch.column(c).slice(at, to - at) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found[c], pa.int64()) for c in COUNTS], keep + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]] + [f"{c} long" for c in names])
    return own.mapInArrow(run, schema).select(*keep, *[F.col(n).alias(c) for n, c in zip(names, COUNTS, strict=True)])


def learn_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = LABELLED) -> list[Rule]:
    """A list that rejects what the labels call 0. Learned from rows whose crc32(id) mod 5 is
    not 0, at most `bound` of them by a hash of the id; rows without an id or label teach
    nothing, repeated rows count again."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    some = own.orderBy(F.xxhash64("id"), "id", "y").limit(bound)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    counted = with_statistics(texts, ["id", "y"]).select("id", "y", F.array(*map(F.expr, FEATURES.values())).alias("x"))
    rows = counted.orderBy(F.xxhash64("id"), "id", "y", "x").limit(bound).collect()
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return learn_list(x, np.array([r.y == 0 for r in rows], dtype=bool))


def quality_rules(df: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    """Per row of df: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under min_words words, or over repeat_percent of them in repeated windows),
    kept, and rule, the list's reason to reject it or null.

    Null texts are empty, and fail for their few words. Null ids stay null, repeated rows
    are counted each; other columns are not looked at. An empty table gives no row.
    """
    named = df.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"))
    counted = with_statistics(named, ["_key"], "_text").withColumn("rule", rejected_by(rules))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return counted.select(F.col("_key").alias(id_col), *COUNTS[:5], failed.alias("base_failed"), (~failed & F.col("rule").isNull()).alias("kept"), "rule")

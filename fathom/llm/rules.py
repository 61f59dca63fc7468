"""Quality rules as a short-circuit cascade, cheapest rejection first.

A rule reads measures of a text and says whether to reject it. Measures cost different amounts of work
and several rules may need the same one. On a bounded sample of texts each measure's time and each rule's
rejections are taken; then rules are put in order greedily: next comes the rule with the most rejections,
among the sample texts still standing, per time of the measures it adds. A text is measured only as far as
the first rule that rejects it. As a text is kept exactly if no rule rejects it, the order saves time and
never changes a verdict.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import add_columns, column_of
from .words import PLAIN, find_words, sequence_hashes

SAMPLE_ROWS = 500
WINDOW = 8
_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Text:
    """A text and what has been measured of it so far."""

    text: str

    def __post_init__(self):
        self.data = self.text.encode("utf-8", "surrogatepass")
        self.known: dict[str, float] = {}

    def get(self, name: str):
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]


def _words(t: Text) -> list[bytes]:
    return t.data.split()


def _repeat_words(t: Text) -> int:
    """Words that stand in a run of ``WINDOW`` words found twice or more in the text."""
    n = len(t.get("word_list"))
    if n <= WINDOW:
        return 0
    data = np.frombuffer(t.data, np.uint8)
    runs = sequence_hashes(find_words(data, np.array([0, len(data)]), PLAIN).hashes, WINDOW)
    order = np.argsort(runs, kind="stable")
    ranked = runs[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(len(runs), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.data.split(b"\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


#: Each measure of a text, by name.
MEASURES: dict[str, Callable[[Text], object]] = {
    "word_list": _words,
    "n_words": lambda t: len(t.get("word_list")),
    "word_chars": lambda t: len(t.text) - (len(t.data) - len(t.data.translate(None, _SPACES))),
    "n_symbols": lambda t: len(t.data) - len(t.data.translate(None, _SYMBOLS)),
    "n_dup_lines": _dup_lines,
    "n_lines": lambda t: sum(1 for x in t.data.split(b"\n") if x.strip(_SPACES)),
    "n_repeat_words": _repeat_words,
    "n_upper": lambda t: sum(1 for c in t.text if c.isupper()),
    "n_letters": lambda t: len(_LETTER.findall(t.text)),
}


@dataclass
class Rule:
    """Rejects a text if ``fails`` is true of the named measures."""

    name: str
    measures: tuple[str, ...]
    fails: Callable[..., bool]


#: The rules of a base that every text is held to.
BASE = (
    Rule("few words", ("n_words",), lambda n: n < 20),
    Rule("repeated words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n),
)
#: Rules against text that is hardly prose; none of them looks at single words of a language.
PROSE = (
    Rule("word length", ("n_words", "word_chars"), lambda n, c: not 2 * n <= c <= 20 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > 3 * n),
    Rule("repeated lines", ("n_lines", "n_dup_lines"), lambda n, d: n >= 4 and 10 * d > 3 * n),
    Rule("capitals", ("n_letters", "n_upper"), lambda n, u: n >= 20 and 10 * u > 6 * n),
    Rule("letters", ("word_chars", "n_letters"), lambda c, n: 10 * n < 6 * c),
)


def trial(rules: tuple[Rule, ...], raw: str) -> tuple[list[float], list[bool]]:
    """Seconds that each measure takes on one text, and which rules reject it."""
    text, spent = Text(raw), dict.fromkeys(MEASURES, 0.0)
    for name in ("word_list", *(m for r in rules for m in r.measures)):
        if name not in text.known:
            start = time.perf_counter()
            text.get(name)
            spent[name] = time.perf_counter() - start
    return list(spent.values()), [bool(r.fails(*map(text.get, r.measures))) for r in rules]


def ordered_rules(rules: tuple[Rule, ...], trials: list[tuple[list[float], list[bool]]]) -> list[Rule]:
    """``rules`` by rejections per time in the trials; without any, as they are."""
    cost = dict.fromkeys(MEASURES, 0.0) | dict(zip(MEASURES, np.sum([t for t, _ in trials], axis=0))) if trials else {}
    verdicts = np.array([v for _, v in trials], bool).reshape(len(trials), len(rules))
    left, standing, paid, order = list(range(len(rules))), np.ones(len(trials), bool), set(), []

    def worth(k: int) -> float:
        return (verdicts[:, k] & standing).sum() / (sum(cost.get(m, 0.0) for m in rules[k].measures if m not in paid) + 1e-9)

    while left:
        best = max(left, key=worth)
        order.append(rules[best])
        left.remove(best)
        standing &= ~verdicts[:, best]
        paid |= set(rules[best].measures)
    return order


def first_failure(text: Text, rules: list[Rule]) -> str | None:
    """The first rule, in the given order, that rejects; later ones are not measured."""
    for rule in rules:
        if rule.fails(*map(text.get, rule.measures)):
            return rule.name
    return None


def cascade(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE + PROSE, text: str = "text", sample_rows: int = SAMPLE_ROWS,
    reported: tuple[str, ...] = (), without: tuple[str, ...] = (),
) -> DataFrame:
    """``docs`` with ``failed_rule`` (null if kept) and ``kept``; ``reported`` names measures to return as well.

    Null is the empty text, which has no words. Rules are ordered on ``sample_rows`` texts, those with
    the smallest hashes; which of several failing rules is named depends on that order, ``kept`` does
    not. Columns with one of the new names are replaced. An empty table gives an empty table.
    """
    order = ordered_rules(rules, _trials(docs, rules, text, sample_rows))

    def make(batch: pa.RecordBatch) -> list:
        failed, measured = [], [[] for _ in reported]
        for raw in column_of(batch, text).to_pylist():
            one = Text(raw or "")
            failed.append(first_failure(one, order))
            for values, name in zip(measured, reported):
                values.append(one.get(name))
        kept = [f is None for f in failed]
        return [*(pa.array(v, pa.int64()) for v in measured), pa.array(failed, pa.string()), pa.array(kept, pa.bool_())]

    fields = "".join(f"{name} long, " for name in reported)
    return add_columns(docs, f"{fields}failed_rule string, kept boolean", make, without)


def _trials(docs: DataFrame, rules: tuple[Rule, ...], text: str, sample_rows: int) -> list[tuple[list[float], list[bool]]]:
    """Trials of the texts with the smallest hashes. Tasks measure; only times and verdicts come back."""
    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    few = max(1, docs.count() // (4 * sample_rows))  # leaves some times as many as wanted to choose from
    sample = whole.where(F.pmod("h", F.lit(few)) == 0).orderBy("h").limit(sample_rows)

    def make(batch: pa.RecordBatch) -> list:
        spent, failed = zip(*(trial(rules, t) for t in column_of(batch, "t").to_pylist()))
        return [pa.array(spent, pa.list_(pa.float64())), pa.array(failed, pa.list_(pa.bool_()))]

    found = add_columns(sample, "spent array<double>, failed array<boolean>", make, without=("t", "h")).toArrow()
    return list(zip(found["spent"].to_pylist(), found["failed"].to_pylist()))

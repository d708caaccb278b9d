"""Quality rules as a short-circuit cascade, as Spark expressions only.

Every rule is a condition that rejects a document.  A bounded sample of rows tells how often
each rule rejects and what one evaluation costs; the rules are then tried by rejections per
second, the best first, and a document that one rule rejects is not shown to the next: what only
later rules need (such as the letters of ``few_letters``) is not computed for it.  The order
decides the cost and never the verdict, because a document stays only if no rule rejects it.

The counts of the contract are made by one generator per row.  Spark neither inlines a generator
nor pushes filters through it, so each array is computed once, whatever is selected above.

Defined results: a null text has no words; a rule that is null for a document does not reject
it; rows that repeat an id or a text are judged each for itself; an empty table gives an empty
result.  Very long texts cost time in proportion to their words (and their logarithm where
windows repeat).  Result columns replace input columns of the same name; names that begin with
``__`` are reserved.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafield.session import configure

# fixed values of the counts: what splits words, what counts as a symbol, words in a window
SPACE = r"[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
NO_LETTERS = r"[^\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]+"

#: rows of the sample that orders the rules
SAMPLE_ROWS = 400
REPEATS = 20  # evaluations of a rule per row of the sample

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``condition`` (SQL over the columns of ``counts`` and the text) rejects a document."""

    name: str
    condition: str


def base_rules() -> list[Rule]:
    return [
        Rule("too_few_words", "n_words < 20"),
        Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ]


def further_rules(text_col: str = "text") -> list[Rule]:
    """Rules with wide margins: ordinary prose in any of the languages passes them."""
    return [
        Rule("symbols", "10 * n_symbols > word_chars"),
        Rule("word_length", "word_chars < 2 * n_words or word_chars > 40 * n_words"),
        Rule("copied_lines", "10 * n_dup_lines > 3 * __n_lines"),
        # digits and ASCII punctuation make up half of the words
        Rule(
            "few_letters",
            f"2 * char_length(regexp_replace(`{text_col}`, '{NO_LETTERS}', '')) > word_chars",
        ),
    ]


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(words: str) -> str:
    """Words in windows that occur twice or more.

    Windows are first compared by a hash (of the hashes of their halves, of four words each); only
    those whose hash occurs twice are compared as texts.
    """
    covered = f"""aggregate(starts, struct(0L as total, 0L as upto),
        (a, s) -> struct(a.total + s + {WINDOW} - greatest(a.upto, s) as total,
                         cast(s + {WINDOW} as long) as upto), a -> a.total)"""

    def twice(ordered: str, key: str) -> str:
        return f"""transform(filter(transform({ordered}, (x, k) -> struct(x.i as i,
            coalesce(x.{key} = get({ordered}, k - 1).{key}, false)
            or coalesce(x.{key} = get({ordered}, k + 1).{key}, false) as twice)), x -> x.twice), x -> x.i)"""

    texts = f"sort_array(transform(alike, i -> struct(array_join(slice({words}, i + 1, {WINDOW}), ' ') as t, i as i)))"
    found = _let("named", texts, _let("starts", f"sort_array({twice('named', 't')})", covered))
    by_hash = "sort_array(transform(wins, (h, i) -> struct(h as h, i as i)))"
    repeated = _let("byhash", by_hash, _let("alike", twice("byhash", "h"), found))
    some = f"case when size(array_distinct(wins)) < size(wins) then {repeated} else 0L end"
    eights = f"""slice(transform(fours, (x, i) -> xxhash64(x, get(fours, i + 4))),
        1, greatest(size(fours) - {WINDOW - 1}, 0))"""
    fours = "transform(hashes, (x, i) -> xxhash64(x, get(hashes, i + 1), get(hashes, i + 2), get(hashes, i + 3)))"
    wins = _let("fours", fours, _let("wins", eights, some))
    return _let("hashes", f"transform({words}, x -> xxhash64(x))", wins)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``COUNTS`` and the helper ``__n_lines`` (lines with a word)."""
    configure(docs.sparkSession)
    split = f"""struct(
        array_remove(split(t, '{SPACE}+'), '') as words,
        filter(split(t, '\\\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]') as lines)"""
    made = f"""struct(
        cast(size(v.words) as long) as n_words,
        cast(char_length(array_join(v.words, '')) as long) as word_chars,
        cast(char_length(t) - char_length(translate(t, '{SYMBOLS}', '')) as long) as n_symbols,
        cast(size(v.lines) - size(array_distinct(v.lines)) as long) as n_dup_lines,
        {_repeat_words('v.words')} as n_repeat_words,
        cast(size(v.lines) as long) as __n_lines)"""
    row = _let("v", split, made)
    own = {*COUNTS, "__n_lines"}
    kept = [c for c in docs.columns if c not in own]
    generated = F.expr(f"inline(transform(array(coalesce(`{text_col}`, '')), t -> {row}))")
    return docs.select(*kept, generated)


def ordered_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS):
    """``(rule, rejected share, seconds)`` by rejections per second, from the first rows found.

    The sample serves the order alone.  A rule's seconds are those of one evaluation: it runs
    ``REPEATS`` times per counted row, less the time of a job that evaluates nothing.
    """
    sample = counts(docs.limit(sample_rows), text_col).cache()
    try:
        rows = sample.count()

        def timed(condition: str) -> tuple[int, float]:
            began = time.perf_counter()
            hits = f"size(filter(sequence(1, {REPEATS}), __k -> coalesce({condition}, false)))"
            total = sample.agg(F.sum(F.expr(hits))).first()[0]
            return (total or 0) // REPEATS, time.perf_counter() - began

        idle = min(timed("__k < 0")[1] for _ in range(3))
        measured = []
        for rule in rules:
            rejected, seconds = timed(rule.condition)
            cost = max(seconds - idle, 1e-9) / (REPEATS * max(rows, 1))
            measured.append((rule, rejected / max(rows, 1), cost))
    finally:
        sample.unpersist()
    return sorted(measured, key=lambda m: -m[1] / m[2])


def rejected_by(rules: list[Rule]) -> Column:
    """Name of the first of ``rules`` that rejects, or null; later rules are not evaluated."""
    column = F.lit(None).cast("string")
    for rule in reversed(rules):
        column = F.when(F.expr(rule.condition), F.lit(rule.name)).otherwise(column)
    return column


def apply_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """All columns of ``docs``, the counts, ``base_failed``, ``kept``."""
    base = base_rules()
    rules = further_rules(text_col) if rules is None else rules
    order = [m[0] for m in ordered_rules(docs, base + rules, text_col)]
    judged = counts(docs, text_col).withColumns(
        {
            "base_failed": F.coalesce(
                F.expr(" or ".join(f"({r.condition})" for r in base)), F.lit(False)
            ),
            "kept": rejected_by(order).isNull(),
        }
    )
    own = [*COUNTS, "base_failed", "kept"]
    return judged.select(*[c for c in docs.columns if c not in own], *own)

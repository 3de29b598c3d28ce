"""Secret scan: fixed-form secrets and high-entropy strings, as DataFrame expressions only.

Spans count code points and exclude their end. Base kinds are the leftmost non-overlapping
matches of a pattern, of which those with a short value are dropped. On top of these, a window
slides over every candidate string of a character class; its Shannon entropy is kept by
incremental counts (one symbol enters, one leaves). The span from the first to the last window
over the class's threshold is reported, unless the candidate is on the allow-list. Candidates are
cut at the spans already reported, and those of the wide class at placeholders, of which only the
part between separators goes; what is left of them is scanned.

Nulls count as empty text; empty text has no spans. Rows are handled alone, so repeated rows
repeat their result. Texts of any length are scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds, in listed order. `quick` matches at least wherever a match passes.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{LEAST,})"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"


@dataclass(frozen=True)
class BaseKind:
    name: str
    pattern: str
    quick: str
    group: int
    least: int


@dataclass(frozen=True)
class EntropyKind:
    """A character class: its symbols, the window and the bits per symbol that make a window hot."""

    name: str
    candidate: str
    alphabet: str
    fold: bool
    window: int
    bits: float


BASE_KINDS = (
    BaseKind("assign", ASSIGN.replace("LEAST", "1"), "(?=[AaPpSsTt])" + ASSIGN.replace("LEAST", "8"), 2, 8),
    BaseKind("access", ACCESS, ACCESS, 0, 16),
    BaseKind("hex", HEX, HEX, 0, 32),
)
ENTROPY_KINDS = (
    EntropyKind("entropy_hex", r"[0-9A-Fa-f]{24,}", "0123456789abcdef", True, 24, 3.2),
    EntropyKind(
        "entropy_base64",
        r"[A-Za-z0-9+/_=-]{24,}",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-",
        False,
        24,
        4.1,
    ),
)
# Whole words of a smaller alphabet, or shorter ones, with digits and letters; the SQL twin doesn't have them. The bits are what
# about 95% of random words of 16 symbols reach.
WORD_KINDS = (
    EntropyKind(
        "entropy_lower",
        r"(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{16,}+(?![A-Za-z0-9])",
        "abcdefghijklmnopqrstuvwxyz0123456789",
        False,
        16,
        3.25,
    ),
    EntropyKind(
        "entropy_upper",
        r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{16,}+(?![A-Za-z0-9])",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
        False,
        16,
        3.2,
    ),
    EntropyKind(
        "entropy_mixed",
        r"(?<![A-Za-z0-9])(?=[a-z0-9]*[A-Z])(?=[A-Z0-9]*[a-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]{16,}+",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        False,
        16,
        3.5,
    ),
)
# Candidates that are no secrets: single-class strings, placeholders, runs of the alphabet, UUIDs, dates.
ALLOW_LIST = (
    r"^[0-9_=+/-]+$",
    r"^[A-Za-z_=+/-]+$",
    r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Xx]{4,}|0{6,}",
    r"0123456789|abcdefgh|ABCDEFGH",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
)
# A part between separators, and what makes a placeholder of it.
PART, HOLDER = r"[A-Za-z0-9]{4,}", "|".join(ALLOW_LIST[2:4])
# Every candidate of every class lies within one of these; all have a digit, by class or by the second allow-list entry.
RUN_LEAST = 16
RUN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{16})(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]++"
SPAN = "array<struct<start:int,stop:int,value:string>>"
KNOWN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _matches(text: Column, pattern: str, quick: str, group: int, least: int) -> Column:
    """Spans of the pattern's matches whose group is long enough, found from the pieces between them."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fields = [F.split(text, pattern, -1).alias("gap"), whole.alias("whole")]
    if group:
        fields.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, piece: Column) -> Column:
        begin = state["at"] + F.length(piece["gap"])
        end = begin + F.coalesce(F.length(piece["whole"]), F.lit(0))
        span = F.struct(begin.alias("start"), end.alias("stop"), piece["whole"].alias("value"))
        return F.struct(
            end.alias("at"),
            F.when(F.length(piece["value" if group else "whole"]) >= least, F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"])
            .alias("spans"),
        )

    found = F.aggregate(F.arrays_zip(*fields), start, step, lambda state: state["spans"])
    return F.when(text.rlike(quick), found).otherwise(F.array().cast(SPAN))


def _hot_range(value: Column, kind: EntropyKind) -> Column:
    """First start and last end, from 0, of the windows over the threshold; null without one.

    The counts of the window's symbols are the characters of a string, one for each symbol of the alphabet, of which a
    step overwrites two.
    """
    width, zero = kind.window, ord("A")
    weight = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])
    hot = (math.log2(width) - kind.bits) * width
    state = F.struct(
        F.lit(chr(zero) * len(kind.alphabet)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def count(counts: Column, symbol: Column) -> Column:
        return F.ascii(F.substring(counts, symbol, F.lit(1))) - zero

    def put(counts: Column, symbol: Column, n: Column) -> Column:
        return F.overlay(counts, F.char(n + zero), symbol, F.lit(1))

    def over_symbols(symbols: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            enters = F.get(symbols, i)
            leaves = F.when(i >= width, F.get(symbols, i - width)).otherwise(F.lit(0))
            up, down = count(s["counts"], enters), count(s["counts"], leaves)
            entered = put(s["counts"], enters, up + 1)
            moved = F.get(weight, up + 1) - F.get(weight, up)
            moved = moved + F.when(leaves > 0, F.get(weight, down - 1) - F.get(weight, down)).otherwise(F.lit(0.0))
            same = enters == leaves
            total = s["sum"] + F.when(same, F.lit(0.0)).otherwise(moved)
            counts = (
                F.when(same, s["counts"]).when(leaves > 0, put(entered, leaves, down - 1)).otherwise(entered)
            )
            # entropy = log2(width) - sum / width; a hot window has little of the sum
            over = (i >= width - 1) & (total <= hot)
            return F.struct(
                counts.alias("counts"),
                total.alias("sum"),
                F.when(over, F.coalesce(s["first"], i - (width - 1))).otherwise(s["first"]).alias("first"),
                F.when(over, i + 1).otherwise(s["last"]).alias("last"),
            )

        steps = F.sequence(F.lit(0), F.size(symbols) - 1)
        return F.aggregate(steps, state, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    letters = F.split(F.lower(value) if kind.fold else value, "")
    return bound(F.transform(letters, lambda c: F.instr(F.lit(kind.alphabet), c)), over_symbols)


def _tagged(spans: Column, name: str, order: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("rank"), s["stop"].alias("stop"), F.lit(name).alias("kind")
        ),
    )


def base_spans(text: Column) -> Column:
    """Array of (start, rank, stop, kind) of the fixed-form secrets, by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    kinds = [
        _tagged(_matches(text, k.pattern, k.quick, k.group, k.least), k.name, order)
        for order, k in enumerate(BASE_KINDS)
    ]
    return F.sort_array(F.concat(*kinds))


def _touches(known: Column, span: Column) -> Column:
    return F.exists(known, lambda k: (k["start"] < span["stop"]) & (span["start"] < k["stop"]))


def _hot_spans(text: Column, kind: EntropyKind, order: int, allow_list: tuple[str, ...]) -> Column:
    def reportable(s: Column) -> Column:
        allowed = F.lit(False)
        for pattern in allow_list:
            allowed = allowed | s["value"].rlike(pattern)
        return ~allowed

    def narrowed(s: Column) -> Column:
        return bound(
            _hot_range(s["value"], kind),
            lambda hot: F.struct((s["start"] + hot["first"]).alias("start"), (s["start"] + hot["last"]).alias("stop")),
        )

    candidates = F.filter(_matches(text, kind.candidate, kind.candidate, 0, kind.window), reportable)
    hot = F.filter(F.transform(candidates, narrowed), lambda s: s["start"].isNotNull())
    return _tagged(hot, kind.name, order)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of the spans, which are sorted by start."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        blank = F.repeat(F.lit(" "), s["stop"] - F.greatest(s["start"], state["at"]))
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.concat(state["parts"], F.array(F.concat(gap, blank))).alias("parts"),
        )

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))


def _run_spans(run: Column, allow_list: tuple[str, ...]) -> Column:
    """The high-entropy spans of one run of candidate characters. A hex string also is a base64 candidate; the narrower class
    keeps it. Each step is bound once, as the next ones use it often."""
    hex_kind, wide_kind = ENTROPY_KINDS
    order = len(BASE_KINDS)

    def with_narrow(narrow: Column) -> Column:
        holders = F.filter(_matches(run, PART, PART, 0, 1), lambda s: s["value"].rlike(HOLDER))
        return bound(_blanked(run, holders), lambda left: with_left(narrow, left))

    def with_left(narrow: Column, left: Column) -> Column:
        wide = F.filter(_hot_spans(left, wide_kind, order + 1, allow_list), lambda s: ~_touches(narrow, s))
        return bound(F.sort_array(F.concat(narrow, wide)), lambda known: bound(
            _blanked(left, known), lambda rest: with_rest(narrow, known, rest)))

    def with_rest(narrow: Column, known: Column, rest: Column) -> Column:
        # what a hex string leaves of a candidate; without one, the hot windows are all known
        more = F.when(F.size(narrow) > 0, _hot_spans(rest, wide_kind, order + 1, allow_list)).otherwise(
            F.array().cast(KNOWN)
        )
        return bound(more, lambda more: bound(_blanked(rest, more), lambda last: F.concat(known, more, words(last))))

    def words(left: Column) -> Column:
        # the classes exclude each other, so that one pass leaves no candidate to another
        return F.concat(*[_hot_spans(left, k, order + 2 + i, allow_list) for i, k in enumerate(WORD_KINDS)])

    return bound(_hot_spans(run, hex_kind, order, allow_list), with_narrow)


def _added_spans(text: Column, base: Column, allow_list: tuple[str, ...]) -> Column:
    """The high-entropy spans of what the base spans leave of the text."""

    def moved(run: Column) -> Column:
        return F.transform(
            _run_spans(run["value"], allow_list),
            lambda s: F.struct(
                (run["start"] + s["start"]).alias("start"),
                s["rank"].alias("rank"),
                (run["start"] + s["stop"]).alias("stop"),
                s["kind"].alias("kind"),
            ),
        )

    def over(left: Column) -> Column:
        return F.sort_array(F.flatten(F.transform(_matches(left, RUN, RUN, 0, RUN_LEAST), moved)))

    return bound(_blanked(text, base), over)


def spans_of(text: Column, allow_list: tuple[str, ...] = ALLOW_LIST) -> Column:
    """Struct of `base`, the fixed-form spans, and `added`, the high-entropy ones outside them, both sorted by start.

    One expression, so that whatever is pushed through it copies it once and not once for each step.
    """
    return bound(
        F.coalesce(text, F.lit("")),
        lambda t: bound(
            base_spans(t),
            lambda base: F.struct(base.alias("base"), _added_spans(t, base, allow_list).alias("added")),
        ),
    )


def with_spans(rows: DataFrame, text: Column, allow_list: tuple[str, ...] = ALLOW_LIST) -> DataFrame:
    """Add `base` and `added`, see spans_of. As rows of a generator: filters on them aren't pushed into the scan, which so runs once."""
    return rows.select("*", F.inline(F.array(spans_of(text, allow_list))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id (as doc_id), base spans, added spans. Other columns are not carried."""
    text = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return with_spans(text, F.col("text")).select("doc_id", "text", "base", "added")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal covered range replaced by a mark; spans sorted by start, null text stays null."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        # a span that begins within the range covered so far only extends it
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        fresh = (s["start"] > state["at"]) | (F.size(state["parts"]) == 0)
        return F.struct(
            F.greatest(state["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(state["parts"], F.array(F.concat(gap, F.lit(mark)))))
            .otherwise(state["parts"])
            .alias("parts"),
        )

    def finish(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))


def cleaned(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with every reported span of the text replaced; the length column follows where text changed."""
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col(f"row.{text_col}")
    spans = F.sort_array(F.concat("base", "added"))
    found = with_spans(rows, text).select("row", spans.alias("spans"))
    done = found.select("row", F.size("spans").alias("n"), redacted(text, F.col("spans")).alias("clean"))

    def column(name: str) -> Column:
        if name == text_col:
            return F.col("clean").alias(name)
        if name == length_col:
            length = F.length("clean").cast(docs.schema[name].dataType)
            return F.when(F.col("n") > 0, length).otherwise(F.col(f"row.{name}")).alias(name)
        return F.col("row").getField(name).alias(name)

    return done.select(*[column(c) for c in docs.columns])


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k.name) for k in BASE_KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )

"""Secrets: patterns of known kinds, and strings whose sliding-window entropy is too high for text.

Everything here is SQL functions of Spark; spans are counted in code points, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,o:int,e:int,kind:string>>"


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# The patterns of the known kinds, with the length that a match must reach.
ASSIGN = ("(" + _either_case("password|passwd|secret|token|api_?key")
          + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, ACCESS_CHARS = "AKIA[A-Z0-9]+", 20
HEX, HEX_CHARS = "[0-9a-f]+", 24
VALUE_CHARS = 6
KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings of one class of characters: runs of ``alphabet`` of at least ``window`` characters.

    A run is reported where some window of that many characters has an entropy of at least ``bits``.
    """

    kind: str
    alphabet: str
    members: str
    window: int
    bits: float


@dataclass(frozen=True)
class EntropyRules:
    """What the entropy scan looks for, and the allow-list: a candidate that matches one of these patterns as
    a whole, is a slug (if ``slugs``), or lies in a base span, is suppressed (base spans themselves stay)."""

    classes: tuple[CharacterClass, ...] = (
        CharacterClass("entropy_hex", "0-9a-fA-F", "0123456789abcdefABCDEF", 24, 3.0),
        CharacterClass("entropy_base64", "A-Za-z0-9+/_-",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.9),
    )
    allowed: tuple[str, ...] = field(default=(
        r"[0-9]+",  # numbers
        r"[A-Za-z]+",  # words, however long
        r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # identifiers in the form of UUIDs
        r"(?i).*(?:example|sample|dummy|placeholder|changeme|0123456789|abcdefgh).*",  # stand-ins
    ))
    slugs: bool = True


def is_slug(candidate: Column) -> Column:
    """Whether a candidate is a path or name of three or more lower-case parts with single separators between.

    Told by plain runs of characters, as a repeated group of a pattern takes a stack frame for each repetition.
    """
    parts = F.char_length(candidate) - F.char_length(F.translate(candidate, "-_/", ""))
    return candidate.rlike("^[a-z0-9_/-]+$") & ~candidate.rlike("^[-_/]|[-_/]$|[-_/][-_/]") & (parts >= 2)


def _found(text: Column, pattern: str, keep, kind: Column) -> Column:
    """Spans of the leftmost non-overlapping matches, those only for which ``keep(match)`` holds.

    ``split`` gives what lies between matches and ``regexp_extract_all`` the matches, in the same order, so
    running lengths are positions. Texts without a match are not walked.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state, pair):
        s = state["at"] + pair["0"]
        e = s + F.char_length(pair["1"])
        span = F.struct(s.alias("s"), F.lit(0).alias("o"), e.alias("e"), kind.alias("kind"))
        return F.struct(e.alias("at"), F.when(keep(pair["1"]), F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).cast(SPAN).alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("0"), hits.alias("1"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda state: state["spans"])).otherwise(
        F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the known kinds, by start and then kind as listed."""
    value = F.char_length
    found = [
        _found(text, ASSIGN, lambda m: value(F.regexp_extract(m, ASSIGN, 2)) >= VALUE_CHARS, F.lit(KINDS[0])),
        # a run that is too short has no match that is long enough, so the length may stand in the pattern
        _found(text, f"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}", lambda m: F.lit(True), F.lit(KINDS[1])),
        _found(text, f"[0-9a-f]{{{HEX_CHARS},}}", lambda m: F.lit(True), F.lit(KINDS[2])),
    ]
    ordered = [F.transform(spans, lambda x, o=o: x.withField("o", F.lit(o))) for o, spans in enumerate(found)]
    return F.array_sort(F.concat(*ordered))


def peak_entropy(candidate: Column, rule: CharacterClass) -> Column:
    """Highest Shannon entropy, in bits, of a window of ``rule.window`` characters.

    The candidate is cut into characters once. The state holds the count of every character of the class, a few
    bits each in whole numbers of 60 bits, and the sum of n log2 n over them. A step takes one character in and,
    once the window is full, one out; it changes two counts and the sum by the difference of their terms, so no
    window is counted anew and the work is in proportion to the length.
    """
    w = rule.window
    bits = w.bit_length()
    each = 60 // bits  # counts in a number
    numbers = [f"n{j}" for j in range(-(-len(rule.members) // each))]
    place = F.array(*[F.lit(rule.members.find(chr(c)) + 1) for c in range(128)])
    term = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)])
    value = lambda n: F.element_at(term, n + 1)
    start = F.struct(*[F.lit(0).cast("long").alias(n) for n in numbers], F.lit(0.0).alias("sum"), F.lit(float(w * 10)).alias("least"))
    one = [F.lit(1 << bits * k).cast("long") for k in range(each)]
    units = F.array(*one)

    def peak(codes):
        def step(state, i):
            into = F.element_at(codes, i)
            gone = F.when(i > w, F.element_at(codes, F.greatest(i - w, F.lit(1)))).otherwise(0)
            held = F.array(*[state[n] for n in numbers])
            # no index here is ever null or 0: element_at counts as never null, whatever its index
            at = lambda c: (F.call_function("div", c - 1, F.lit(each)), (c - 1) % each)
            (jn, kn), (jg, kg) = at(into), at(F.greatest(gone, F.lit(1)))
            count = lambda j, k: F.call_function("div", F.element_at(held, j.cast("int") + 1), F.element_at(units, k + 1)) % (1 << bits)
            a, b = count(jn, kn).cast("int"), F.greatest(count(jg, kg).cast("int"), F.lit(1))
            same = into == gone
            less = F.when(gone > 0, value(b - 1) - value(b)).otherwise(0.0)
            total = F.when(same, state["sum"]).otherwise(state["sum"] + value(a + 1) - value(a) + less)
            plus, minus = F.element_at(units, kn + 1), F.when(gone > 0, F.element_at(units, kg + 1)).otherwise(0)
            moved = [(state[n] + F.when(jn == j, plus).otherwise(0) - F.when(jg == j, minus).otherwise(0)).alias(n)
                     for j, n in enumerate(numbers)]
            least = F.when(i >= w, F.least(state["least"], total)).otherwise(state["least"])
            return F.struct(*moved, total.alias("sum"), least.alias("least"))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step,
                           lambda state: F.lit(math.log2(w)) - state["least"] / w)

    codes = F.transform(F.split(candidate, ""), lambda c: F.element_at(place, F.ascii(c) + 1))
    # an array of one array: the lambda's variable holds the codes, which a step would else make anew
    return F.element_at(F.transform(F.array(codes), peak), 1)


def entropy_spans(text: Column, base: Column, rules: EntropyRules) -> Column:
    """Spans of candidates whose entropy is high, without those on the allow-list or inside a base span."""
    found = []
    for o, rule in enumerate(rules.classes, start=len(KINDS)):
        allowed = is_slug if rules.slugs else lambda m: F.lit(False)
        for pattern in rules.allowed:
            allowed = lambda m, p=pattern, rest=allowed: rest(m) | m.rlike(f"^(?:{p})$")
        spans = _found(text, f"[{rule.alphabet}]{{{rule.window},}}",
                       lambda m, r=rule, ok=allowed: F.when(ok(m), False).otherwise(peak_entropy(m, r) >= r.bits),
                       F.lit(rule.kind))
        found.append(F.transform(spans, lambda x, o=o: x.withField("o", F.lit(o))))
    return F.filter(F.concat(*found), lambda x: ~F.exists(base, lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text",
                 rules: EntropyRules = EntropyRules()) -> DataFrame:
    """(doc_id, base, spans) for every row: the spans of the known kinds, and these with the entropy spans,
    each an array of (s, o, e, kind) by start and then kind.

    A null text counts as empty and has no spans. Repeated rows are scanned each, a null key stays null, an
    empty table gives an empty one, other columns are left out. No shuffle: a row is scanned where it lies,
    whatever its source, and texts are scanned whole.
    """
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("base", base_spans(F.col("body")))
    rows = rows.withColumn("more", entropy_spans(F.col("body"), F.col("base"), rules))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def mask_secrets(docs: DataFrame, text: str = "text", chars: str = "n_chars", mask: str = "[SECRET]",
                 rules: EntropyRules = EntropyRules()) -> DataFrame:
    """Rows of ``docs`` with every span replaced by ``mask``; overlapping spans are masked once.

    ``chars``, where there is such a column, is the new length for texts that changed. Texts without spans,
    null ones too, and all other columns are as before.
    """
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    base = base_spans(body)
    names = docs.columns
    own = "found in " + " ".join(names)  # a name that no column has
    rows = docs.withColumn(own, base)
    rows = rows.withColumn(own, F.array_sort(F.concat(rows[own], entropy_spans(body, rows[own], rules))))
    spans = rows[own]
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, x):
        cut = F.when(x["s"] >= state["at"], F.concat(
            state["out"], F.substring(rows[text], state["at"] + 1, x["s"] - state["at"]), F.lit(mask))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), cut.alias("out"))

    clean = F.aggregate(spans, start, step, lambda state: F.concat(
        state["out"], F.substring(rows[text], state["at"] + 1, F.char_length(rows[text]))))
    changed = F.size(spans) > 0
    out = rows.withColumn(text, F.when(changed, clean).otherwise(rows[text]))
    if chars in names:
        kind = docs.schema[chars].dataType
        out = out.withColumn(chars, F.when(changed, F.char_length(out[text]).cast(kind)).otherwise(out[chars]))
    return out.select(*names)

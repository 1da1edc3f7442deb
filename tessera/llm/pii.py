"""Personal data: patterns propose spans, validators confirm them, words nearby adjust the score.

Everything is a Catalyst expression. For each kind the text is cut once by the pattern; the pieces
between matches and the matches themselves give the positions in time linear in the text, and only
where a cheap test says that the kind can occur at all.

Kinds `email`, `ip`, `card` and `phone` are kept whenever their pattern and their validator hold.
`iban`, `short_card`, `national_id` and `secret` are kept when their score reaches ``THRESHOLD``: the prior, plus 0.3 for a
checksum, plus 0.2 for a word of the kind within ``CONTEXT_CHARS`` before or behind the span, less 0.2 for a word
of ``AGAINST`` right before it. The context is that of the text, whatever other matches stand in it.

Null and empty texts have no spans. Positions are code points, end exclusive. Repeated rows are treated
one by one; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
CONTEXT_CHARS = 40
#: Numbers right behind these are mostly no personal data; \1 stands for the span.
AGAINST = r"\b(?:order|invoice|tracking|serial|part|article|version|build|commit|checksum|sha[0-9]*|md5)\b[^\x01]{0,10}\x01"
BLOCK = 256
_SPANS = "array<struct<start:int,end:int,score:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` more than once."""
    return F.transform(F.array(value), body)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn checksum of a string of digits holds."""

    def weighed(back: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            d = F.substring(back, i, F.lit(1)).cast("int")
            twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
            return acc + F.when(i % 2 == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(back), F.lit(1))), F.lit(0), add) % 10 == 0

    return _let(F.reverse(digits), weighed)


def mod97(m: Column) -> Column:
    """ISO 7064 mod 97-10 of an account number whose first four characters go last."""

    def rest(moved: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            code = F.ascii(F.substring(moved, i, F.lit(1)))
            return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(moved), F.lit(1))), F.lit(0), add) == 1

    bare = F.regexp_replace(m, "[^A-Z0-9]", "")
    return _let(F.concat(F.substring(bare, F.lit(5), F.lit(64)), F.substring(bare, 1, 4)), rest)


@dataclass(frozen=True)
class Kind:
    name: str
    base: bool
    #: Matches the same spans as the plain pattern, but starts only where a run starts and never backs up.
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    prior: float
    checked: bool
    context: str


_OCTETS = r"^(0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.|$)){4}$"

KINDS = (
    Kind("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), lambda m: F.lit(True), 0.8, False, "mail|contact|write|reach"),
    Kind("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(_OCTETS), 0.6, False, r"\bip\b|address|host|server|login"),
    Kind("card", True, r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), lambda m: F.length(_digits(m)).between(16, 19) & luhn(_digits(m)), 0.5, True, "card|visa|credit|debit|payment|kredit|carte|tarjeta"),
    Kind("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(8, 15), 0.6, False, "phone|tel|call|mobil|fax|whatsapp"),
    Kind("iban", False, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){2,8}(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), lambda m: F.length(F.regexp_replace(m, r"\x20", "")).between(15, 34) & mod97(m), 0.5, True, "iban|account|bank|konto|compte|cuenta"),
    Kind("short_card", False, r"(?<![0-9.+-])[0-9](?:[\x20-]?[0-9])++(?![0-9.])", lambda t: t.rlike(r"(?:[0-9][\x20-]?){12}[0-9]"), lambda m: F.length(_digits(m)).between(13, 15) & luhn(_digits(m)), 0.3, True, "card|visa|amex|credit|debit|payment|kredit|carte|tarjeta"),
    Kind("secret", False, r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,200}+(?![A-Za-z0-9_+/-])", lambda t: t.rlike("[A-Za-z0-9_+/-]{20}"), lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10), 0.5, False, r"token|secret|passw|passphrase|api.?key|access.?key|private.?key|credential|bearer"),
    Kind("national_id", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda m: F.lit(True), 0.5, False, r"ssn|social security|national id|\bid\b"),
)


def _score(kind: Kind, near: Column) -> Column:
    def of(t: Column) -> Column:
        return F.lit(kind.prior + 0.3 * kind.checked) + F.when(t.rlike(kind.context), 0.2).otherwise(0.0) - F.when(t.rlike(AGAINST), 0.2).otherwise(0.0)

    return F.round(_let(F.lower(near), of), 2)


def _cut(kind: Kind, text: Column) -> Column:
    """Pieces before each match and the matches; the last piece has a null match."""
    return F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))


def _around(pieces: Column, i: Column) -> Column:
    """``CONTEXT_CHARS`` of the text before and behind match ``i``. A match has two characters at least, so that many
    characters are within half as many pieces."""
    reach = CONTEXT_CHARS // 2
    told = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(x["p"], F.coalesce(x["m"], F.lit("")))), "")
    first = F.greatest(i - reach, F.lit(0))
    before = F.concat(told(F.slice(pieces, first + 1, i - first)), F.get(pieces, i)["p"])
    return F.concat_ws("\1", F.right(before, F.lit(CONTEXT_CHARS)), F.left(told(F.slice(pieces, i + 2, F.lit(reach + 1))), F.lit(CONTEXT_CHARS)))


def spans(kind: Kind, text: Column) -> Column:
    """array<struct<start,end,score>> in order of position. Prefix sums go by blocks of ``BLOCK`` matches."""

    def step(pieces: Column):
        def of(acc: Column, x: Column) -> Column:
            start = acc["pos"] + F.length(x["p"])
            end = start + F.coalesce(F.length(x["m"]), F.lit(0))
            scored = _let(_score(kind, _around(pieces, acc["i"])), lambda s: F.struct(start.alias("start"), end.alias("end"), s.alias("score")))
            valid = x["m"].isNotNull() & F.coalesce(kind.valid(x["m"]), F.lit(False))
            found = F.when(valid, F.filter(F.array(scored), lambda s: F.lit(kind.base) | (s["score"] >= THRESHOLD))).otherwise(F.array().cast(_SPANS))
            return F.struct(end.alias("pos"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], found).cast(_SPANS).alias("out"))

        return of

    def whole(pieces: Column) -> Column:
        last = F.greatest(F.floor((F.size(pieces) - 1) / BLOCK), F.lit(0)).cast("int")
        empty = lambda k: F.struct(F.lit(0).alias("pos"), (k * BLOCK).cast("int").alias("i"), F.array().cast(_SPANS).alias("out"))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK)), empty(k), step(pieces)))

        def shifted(bs: Column) -> Column:
            offsets = F.aggregate(bs, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["pos"])))
            moved = F.zip_with(bs, offsets, lambda b, o: F.transform(F.coalesce(b["out"], F.array().cast(_SPANS)), lambda s: F.struct((s["start"] + o).alias("start"), (s["end"] + o).alias("end"), s["score"].alias("score"))))
            return F.flatten(moved)

        return _let(blocks, shifted)

    none = F.array().cast(_SPANS)
    return F.when(kind.gate(text), _let(_cut(kind, text), whole)).otherwise(none)


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and one array of spans per kind, named by the kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.struct(*[spans(k, text).alias(k.name) for k in KINDS])
    # the generator keeps Catalyst from repeating the search for each use of its result
    return docs.select(*keep, F.inline(F.array(found)))


def listed(kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    return F.array_join(F.concat(*[_named(k) for k in kinds]), ",")


def _named(kind: Kind) -> Column:
    return F.transform(F.col(kind.name), lambda s: F.concat_ws(":", F.lit(kind.name), s["start"].cast("string"), s["end"].cast("string")))


def listed_scores(kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The scores of the spans as ``listed`` has them, comma-joined."""
    return F.array_join(F.concat(*[F.transform(k.name, lambda s: F.format_number(s["score"], 2)) for k in kinds]), ",")


#: Code points in a block of a text that is taken apart, so that a piece is found without reading the text from its start.
TEXT_BLOCK = 4096
_NAMED = "array<struct<start:int,end:int,name:string>>"


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in blocks of ``TEXT_BLOCK``."""
    first = F.floor(start / TEXT_BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(end / TEXT_BLOCK).cast("int") - first + 1), "")
    return F.substring(some, start - first * TEXT_BLOCK + 1, end - start)


def disjoint(found: Column) -> Column:
    """Spans in order; those that overlap are one, named like the first, of equal starts the longest."""

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["name"].alias("name"))
        over = (F.size(acc) > 0) & (x["start"] < F.try_element_at(acc, F.lit(-1))["end"])
        return F.when(over, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x))).cast(_NAMED)

    def checked(s: Column) -> Column:
        overlaps = F.size(F.filter(s, lambda x, i: (i > 0) & (x["start"] < F.get(s, i - 1)["end"]))) > 0
        return F.when(overlaps, F.aggregate(s, F.array().cast(_NAMED), merge)).otherwise(s)

    inorder = F.transform(F.array_sort(F.transform(found, lambda x: F.struct(x["start"], (-x["end"]).alias("e"), x["name"]))), lambda x: F.struct(x["start"].alias("start"), (-x["e"]).alias("end"), x["name"].alias("name")))
    return _let(inorder.cast(_NAMED), checked)


def redacted(text: Column) -> Column:
    """``text`` with every span of ``find`` replaced by its kind in brackets, overlapping ones by one. Null stays null."""
    def of(kind: Kind) -> Column:
        return F.transform(spans(kind, text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.name).alias("name")))

    found = F.concat(*[of(k) for k in KINDS])

    def rebuilt(s: Column) -> Column:
        def told(blocks: Column) -> Column:
            parts = F.transform(s, lambda x, i: F.concat(_between(blocks, F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]), x["start"]), F.lit("["), F.upper(x["name"]), F.lit("]")))
            return F.concat(F.array_join(parts, ""), _between(blocks, F.element_at(s, -1)["end"], F.length(text)))

        return F.when(F.size(s) > 0, _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)), told)).otherwise(text)

    return F.when(text.isNotNull(), _let(disjoint(found), rebuilt))

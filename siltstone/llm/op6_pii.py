"""Personal data, with DataFrame functions only.

Regular expressions propose spans; validators confirm them (octets of an address,
Luhn for cards, the number of digits for phones, mod 97 for account numbers); words
shortly before or after a span (up to the next match of its kind) raise its score. Base spans (email, ip, card, phone) are kept whatever
their score; the kinds that the method adds (iban, id_number) need a score of
``threshold``. Matches that fail their validator are dropped and not tried again.

The patterns are written so that the engine's matcher takes linear time and no recursion
on any text: possessive repeats where nothing that follows could use a shorter
one, and a look behind where a later start in the same run could only fail again.

A span's place comes from the texts between matches: ``split`` and
``regexp_extract_all`` walk the same matches, so a match starts where the parts and
matches before it end (code points, end exclusive). Arrays can only be grown by copying and texts only be cut by counting from their
start, so matches are taken ``CHUNK`` at a time: the cost of a text with n spans is n * CHUNK + (n / CHUNK) ** 2 small steps, not n ** 2.

Defined results: null and empty texts have no spans, and the digest of the empty string;
every row is judged by itself, so repeated rows and null doc_ids are returned as they are; very long texts are searched whole; spans of
one start go by kind; other columns stay as they are, but for ``findings``, which ``find`` replaces; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of ties. Fixed values.
KINDS = ("email", "ip", "card", "phone", "iban", "id_number")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "id_number": "-"}
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "id_number": 0.4}
CONTEXT = {
    "email": r"mail|contact|write|address",
    "ip": r"\bip\b|server|host|address|network",
    "card": r"card|visa|credit|payment|amex",
    "phone": r"phone|call|tel|mobile|fax|contact",
    "iban": r"iban|account|bank|transfer",
    "id_number": r"ssn|social|security|identity|passport|tax",
}
CONTEXT_RAISE, CONTEXT_CHARS, THRESHOLD, CHUNK = 0.3, 40, 0.6, 128
BASE = KINDS[:4]


def _luhn(text: Column) -> Column:
    digits = F.reverse(F.regexp_replace(text, r"[^0-9]", ""))
    at = F.sequence(F.lit(1), F.length(digits))

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return (F.length(digits).between(12, 19)) & (F.aggregate(at, F.lit(0), lambda s, i: s + value(i)) % 10 == 0)


def _mod97(text: Column) -> Column:
    plain = F.regexp_replace(text, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    at = F.sequence(F.lit(1), F.length(turned))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.length(plain).between(15, 34) & (F.aggregate(at, F.lit(0), step) == 1)


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, r"[^0-9]", "")).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "id_number":
        return ~match.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once: expressions inside lambdas are computed at every step, their arguments are not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chunks(items: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The numbers of the array's chunks of ``CHUNK``, and what gives one by its number."""
    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))), lambda k: F.slice(items, k * CHUNK + 1, CHUNK)


def _found(text: Column, kind: str) -> Column:
    """The kind's confirmed spans: array of (start, kind's number, end, score)."""
    pattern = F.lit(PATTERNS[kind])
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    number = KINDS.index(kind)

    def step(state: Column, pair: Column) -> Column:
        """The state: where the last match ended, and the chunk's spans so far."""
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        near = F.lower(F.concat_ws(" ", F.right(pair["gap"], F.lit(CONTEXT_CHARS)), F.left(pair["after"], F.lit(CONTEXT_CHARS))))
        score = F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_RAISE)).otherwise(F.lit(0.0)))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), score.alias("score"))
        kept = _valid(kind, pair["match"]) & (F.lit(kind in BASE) | (score >= THRESHOLD))
        return F.struct(end.alias("at"), F.when(kept, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    def of(pairs: Column) -> Column:
        numbers, chunk = _chunks(pairs)
        long = F.transform(numbers, lambda k: F.aggregate(chunk(k), F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["match"])))
        starts = F.aggregate(long, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        spans = lambda k, at: F.aggregate(chunk(k), F.struct(at.alias("at"), none.alias("spans")), step, lambda s: s["spans"])
        return _let(starts, lambda s: F.flatten(F.transform(numbers, lambda k: spans(k, F.get(s, k)))))

    def paired(matches: Column) -> Column:
        gaps = lambda between: F.transform(matches, lambda m, i: F.struct(F.get(between, i).alias("gap"), m.alias("match"), F.get(between, i + 1).alias("after")))
        return _let(F.split(text, PATTERNS[kind], -1), lambda between: _let(gaps(between), of))

    has = text.contains(NEEDS[kind]) if kind in NEEDS else text.rlike({"card": r"[0-9][\x20-]?[0-9]", "iban": r"[A-Z]{2}[0-9]{2}"}[kind])
    spans = _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.when(F.size(m) > 0, paired(m)).otherwise(none))
    return F.when(F.coalesce(has, F.lit(False)), spans).otherwise(none)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``findings``: array of (start, kind, end, score), by start, then kind."""
    text = F.col("text")
    return docs.withColumn("findings", F.array_sort(F.concat(*[_found(text, kind) for kind in KINDS])))


def _name(span: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    spans = F.col("findings")
    counts = [F.size(_of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = _listed(F.filter(spans, lambda s: s["kind"] < len(BASE)))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def redact(found: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with each span of ``text`` replaced by its kind in brackets; of spans that overlap, the first names them all."""
    text, spans = F.col("text"), F.col("findings")
    parts = F.array().cast("array<string>")

    def step(state: Column, s: Column) -> Column:
        """The state: the chunk's text, where it begins, where the last span ended, and the parts so far."""
        label = F.concat(F.lit("["), F.upper(_name(s)), F.lit("]"))
        gap = F.substring(state["text"], state["at"] - state["from"] + 1, s["start"] - state["at"])
        new = F.when(s["start"] >= state["at"], F.concat(state["parts"], F.array(gap, label))).otherwise(state["parts"])
        return F.struct(state["text"].alias("text"), state["from"].alias("from"), F.greatest(state["at"], s["end"]).alias("at"), new.alias("parts"))

    def of(chunks: Column) -> Column:
        """Each chunk's part of the text reaches from the end of those before it to its own end."""
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        upto = F.aggregate(ends, F.array(F.lit(0)), lambda a, e: F.array_append(a, F.greatest(F.element_at(a, -1), e)))

        def one(c: Column, at: Column, end: Column) -> Column:
            start = F.struct(F.substring(text, at + 1, end - at).alias("text"), at.alias("from"), at.alias("at"), parts.alias("parts"))
            return F.aggregate(c, start, step, lambda s: F.array_join(s["parts"], ""))

        whole = lambda u: F.concat(F.array_join(F.transform(chunks, lambda c, k: one(c, F.get(u, k), F.get(u, k + 1))), ""), F.substring(text, F.element_at(u, -1) + 1, F.length(text)))
        return _let(upto, whole)

    def cut(some: Column) -> Column:
        numbers, chunk = _chunks(some)
        return F.transform(numbers, chunk)

    new = F.when(F.size(spans) > 0, _let(_let(spans, cut), of)).otherwise(text)
    return found.select(*[new.alias("text") if c == "text" else F.col(c) for c in columns])

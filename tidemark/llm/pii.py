"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Everything is a column expression. For each kind the matches (`regexp_extract_all`) and the text
between them (`split`) give the code-point positions; digits are summed by Luhn's rule and account
numbers taken modulo 97 with array functions; the words just before and after a match raise or lower
its score. Patterns never rescan a run of characters; positions are running sums taken in chunks and redaction
cuts an array of characters, so the cost grows with the text and its matches (chunks of `CHUNK` keep the remaining square
term small). Context ends at the neighbouring match of its kind.

Kinds: email, ip, card and phone are kept whenever their own check holds. The method adds iban (mod-97
holds; words after the number are left out, the longest run of words that holds counts) and id_number (three-two-four digits, kept only if a context word stands nearby).

Null and empty texts have no spans. Every row is judged by its own text: repeated rows repeat their results, null ids
are nothing special. Other columns pass through in `redact`, whatever their names; `find_spans` keeps only the id. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the four base kinds and of the two added ones. A look-behind with \G (the end
# of the match before) and possessive quantifiers keep the leftmost matches of the plain pattern.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # every start is a match of two letters; group 1 is the longest text that may belong to the number
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9]))[A-Z]{2}",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
KINDS = list(PATTERNS)
# Words that speak for a kind when they stand near a match.
CONTEXT = {
    "email": r"(?i)mail|contact|reach|write",
    "ip": r"(?i)\bip\b|host|server|address|login",
    "card": r"(?i)card|visa|credit|debit|payment|expir",
    "phone": r"(?i)phone|call|tel|mobile|fax",
    "iban": r"(?i)iban|account|bank|transfer",
    "id_number": r"(?i)ssn|social|security|tax|ident",
}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "id_number": 0.3}
CONTEXT_GAIN = 0.2
#: Added kinds need this score; base kinds stay whatever their score.
KEEP_SCORE = 0.5
#: Code points looked at on either side of a match.
CONTEXT_WIDTH = 40
_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


#: Entries of one chunk of a running sum.
CHUNK = 128


def _fold(values: Column, combine) -> Column:
    """Running combination of an array of numbers >= 0 by a fold that grows its result; for short arrays."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        at = combine(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc["out"])


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine) -> Column:
    """Running combination (sum, maximum) of an array of numbers >= 0, by chunks: each chunk on its own, then the
    chunks' last values."""

    def chunked(v):
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / CHUNK).cast("int")), lambda c: _fold(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), combine))
        return _let(chunks, shifted)

    def shifted(each):
        last = F.concat(F.array(F.lit(0)), _fold(F.transform(each, lambda c: F.get(c, F.size(c) - 1)), combine))
        return F.flatten(F.zip_with(each, F.slice(last, F.lit(1), F.size(each)), lambda c, b: F.transform(c, lambda x: combine(x, b))))

    return _let(values, chunked)


def _after(ends: Column) -> Column:
    """For each of the ends the largest one before it, 0 for the first; and at the end the largest of all."""
    return F.concat(F.array(F.lit(0)), _running(ends, lambda a, b: F.greatest(a, b)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _codes(x: Column) -> Column:
    """Character codes of a string, in order."""
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.ascii(F.substr(x, i, F.lit(1))))


def luhn(digits: Column) -> Column:
    """Whether a non-empty string of digits passes Luhn's check."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    each = F.transform(_codes(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c - 48).otherwise(doubled(c - 48)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    bare = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    rest = F.aggregate(_codes(turned), F.lit(0), lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97))
    return rest == 1


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")
    if kind == "card":
        n = F.length(_digits(x))
        return F.when(n.between(12, 19), luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Array of (start, no, stop, score) of one kind, in order of start."""
    if kind == "iban":
        return _accounts(text)
    pattern = F.lit(PATTERNS[kind])
    no = KINDS.index(kind)

    def spans(v):
        m, gaps, n = v["m"], v["g"], F.size(v["m"])
        stops = _running(F.zip_with(F.slice(gaps, F.lit(1), n), m, lambda b, x: F.length(b) + F.length(x)), lambda a, b: a + b)
        # one entry a match: where it ends, the text before it and the text after it
        parts = F.arrays_zip(stops.alias("e"), m.alias("m"), F.slice(gaps, F.lit(1), n).alias("b"), F.slice(gaps, F.lit(2), n).alias("a"))
        found = F.transform(F.filter(parts, lambda x: _valid(kind, x["m"])), span)
        return found if kind in ("email", "ip", "card", "phone") else F.filter(found, lambda s: s["score"] >= KEEP_SCORE)

    def span(x):
        near = F.right(x["b"], F.lit(CONTEXT_WIDTH)).rlike(CONTEXT[kind]) | F.left(x["a"], F.lit(CONTEXT_WIDTH)).rlike(CONTEXT[kind])
        score = F.lit(BASE_SCORE[kind]) + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.struct((x["e"] - F.length(x["m"])).cast("int").alias("start"), F.lit(no).alias("no"), x["e"].cast("int").alias("stop"), score.alias("score"))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("g"))
    return F.when(F.regexp_like(text, pattern), _let(both, spans)).otherwise(F.array().cast(SPANS))


def _account(longest: Column) -> Column:
    """The longest valid account number that ends where a word of `longest` ends; null without one."""
    words = F.split(longest, " ")
    ends = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    return F.get(F.filter(ends, lambda x: (F.length(F.regexp_replace(x, " ", "")) >= 15) & mod97(x)), F.lit(0))


def _accounts(text: Column) -> Column:
    """Array of (start, no, stop, score) of account numbers, in order of start, none within another."""
    pattern = F.lit(PATTERNS["iban"])

    def spans(v):
        longest, gaps, n = v["m"], v["g"], F.size(v["m"])
        # a match is two letters
        twos = _running(F.transform(F.slice(gaps, F.lit(1), n), lambda b: F.length(b) + 2), lambda a, b: a + b)
        each = F.arrays_zip(F.transform(twos, lambda e: e - 2).alias("start"), F.transform(longest, _account).alias("m"), F.slice(gaps, F.lit(1), n).alias("b"), longest.alias("l"))
        return _let(F.filter(each, lambda x: x["m"].isNotNull()), apart)

    def apart(found):
        # one that starts within an earlier one is left out
        upto = _after(F.transform(found, lambda x: x["start"] + F.length(x["m"])))
        return F.transform(F.filter(F.zip_with(found, F.slice(upto, F.lit(1), F.size(found)), lambda x, u: F.struct(x.alias("x"), u.alias("u"))), lambda z: z["x"]["start"] >= z["u"]), lambda z: span(z["x"]))

    def span(x):
        after = F.substr(x["l"], F.length(x["m"]) + 1, F.lit(CONTEXT_WIDTH))
        near = F.right(x["b"], F.lit(CONTEXT_WIDTH)).rlike(CONTEXT["iban"]) | after.rlike(CONTEXT["iban"])
        score = F.lit(BASE_SCORE["iban"]) + F.when(near, F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
        return F.struct(x["start"].cast("int").alias("start"), F.lit(KINDS.index("iban")).alias("no"), (x["start"] + F.length(x["m"])).cast("int").alias("stop"), score.alias("score"))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(1)).alias("m"), F.split(text, PATTERNS["iban"], -1).alias("g"))
    return F.when(F.regexp_like(text, pattern), _let(both, spans)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,no:int,stop:int,score:double>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and `spans`, an array of (kind, start, end, score) in code points, end
    exclusive, by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    each = docs.select(F.col(id_col), *[_found(text, k).alias(f"_{k}") for k in KINDS])
    merged = F.array_sort(F.concat(*[F.col(f"_{k}") for k in KINDS]))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(merged, lambda s: F.struct(F.element_at(names, s["no"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("end"), s["score"].alias("score")))
    return each.select(id_col, named.alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """`text` with every span replaced by its kind in angle brackets; overlapping spans are replaced once, by the first."""
    cut = lambda letters, start, end: F.array_join(F.slice(letters, start + 1, end - start), "")

    def replaced(v):
        letters, upto = v["c"], v["u"]
        # a span that starts before an earlier one ends only moves the place where the text goes on
        first = F.filter(F.zip_with(spans, F.slice(upto, F.lit(1), F.size(spans)), lambda s, u: F.struct(s.alias("s"), u.alias("u"))), lambda z: z["s"]["start"] >= z["u"])
        parts = F.transform(first, lambda z: F.concat(cut(letters, z["u"], z["s"]["start"]), F.lit("<"), F.upper(z["s"]["kind"]), F.lit(">")))
        end = F.element_at(upto, -1)
        return F.concat(F.array_join(parts, ""), cut(letters, end, F.greatest(F.size(letters), end)))

    both = F.struct(F.split(text, "").alias("c"), _after(F.transform(spans, lambda s: s["end"])).alias("u"))
    return F.when(F.size(spans) > 0, _let(both, replaced)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in `text` replaced; null texts stay null."""
    text = F.col(text_col)
    each = docs.select("*", *[_found(F.coalesce(text, F.lit("")), k).alias(f"_tm_{k}") for k in KINDS])
    merged = F.array_sort(F.concat(*[F.col(f"_tm_{k}") for k in KINDS]))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(merged, lambda s: F.struct(F.element_at(names, s["no"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("end")))
    with_spans = each.select(*[F.col(c) for c in docs.columns], spans.alias("_tm_spans"))
    return with_spans.select(*[(redacted(text, F.col("_tm_spans")).alias(c) if c == text_col else F.col(c)) for c in docs.columns])

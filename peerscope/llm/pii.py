"""Personal data: patterns propose spans, validators confirm them, nearby words adjust the score.

Every kind is a row of KINDS: a pattern, a validator over the matched text, a base score and context words. Matches
of one kind do not overlap and go from left to right; a match that its validator drops is not retried. The four base
kinds have score 1 and always stay. The added kinds (IBAN, national id, unprefixed phone, secrets, keys of known form) are
kept from THRESHOLD on: a match its validator drops scores 0; a passing checksum or entropy test and a context word within
WINDOW characters raise the score, words that speak for something else lower it, whatever matches stand between.

Positions come from splitting the text at the matches: the lengths of the pieces and matches, summed up, are the spans.
Patterns use possessive quantifiers and start guards so that their cost is linear in the text and Java's matcher does
not recurse; the guards only skip starts that cannot win.

Defined results: null counts as empty; empty texts have no spans and the digest of the empty string; repeated rows are
judged alike; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, let, unused

THRESHOLD = 0.6
WINDOW = 40
RAISE, LOWER = 0.35, 0.25
#: Bits per character from which a string counts as random, and the least length of one.
ENTROPY, SECRET = 3.0, 20


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    cheap: str  # a text where this isn't found needs no matching
    valid: object
    score: float = 1.0
    checked: float = 0.0  # added for the validator, which all matches must pass
    context: str = ""  # RAISE is added where this is found nearby
    against: str = ""  # LOWER is taken off where this is found nearby


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def small_parts(m: Column) -> Column:
    part = r"(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]))"
    return m.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), F.call_function("luhn_check", d)).otherwise(F.lit(False))


def phone_digits(m: Column) -> Column:
    return F.length(digits(m)).between(10, 15)


def mod97(m: Column) -> Column:
    """ISO 7064 mod 97-10 over the letters and digits, the first four moved to the end."""
    s = F.upper(F.regexp_replace(m, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(s, 5, 60), F.substring(s, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
    return F.length(s).between(15, 34) & (rest == 1)


def random_looking(m: Column) -> Column:
    """Letters and digits, of a Shannon entropy of at least ENTROPY bits per character; padding counts like the rest."""
    share = lambda c: (F.length(m) - F.length(F.replace(m, c, F.lit("")))) / F.length(m)
    bits = F.aggregate(F.array_distinct(F.filter(F.split(m, ""), lambda c: c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (bits >= ENTROPY)


LOCAL = "[A-Za-z0-9._%+-]"
#: Length of an IBAN by country, from the ISO 13616 registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE BI", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HN HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BF CF DJ FR GR IT MC MR", 28: "AL AZ BJ BY CI CM CY DO DZ GT GW HU KM LB MG ML MZ NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_REGISTERED = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in IBAN_LENGTHS.items())
_REGISTERED = rf"(?:{_REGISTERED})(?![A-Za-z0-9])"
#: A registered country's length is tried first, so that a word or number after the IBAN stays outside. Other lengths and
#: codes take all that follows up to 34 characters, but never the start of a registered IBAN.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_REGISTERED}|[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_REGISTERED})\x20?[A-Z0-9]{{4}}){{2,7}}+(?:(?!\x20{_REGISTERED})\x20?[A-Z0-9]{{1,3}})?+(?![A-Za-z0-9]))"
#: Words by which a number is likely something else.
NUMBERS = r"(?i)\b(?:sample|dummy|placeholder|fictitious|part number|order number|invoice number)\b"
_CODE = "A-Za-z0-9_+/-"
#: Order matters: spans that start together are listed in this order. The first four are the base kinds.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True)),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", small_parts),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", "[0-9][0-9\x20-]{12}", luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", phone_digits),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", mod97, 0.3, 0.5, r"(?i)iban|account|konto|compte|cuenta|bank", NUMBERS),
    Kind("national_id", r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])", "[0-9]-[0-9]", lambda m: ~m.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$"), 0.1, 0.25, r"(?i)ssn|social security|national id|tax id", NUMBERS),
    Kind("local_phone", r"(?<![A-Za-z0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![A-Za-z0-9-])", r"[0-9][-.\x20][0-9]{4}", lambda m: F.lit(True), 0.1, 0.25, r"(?i)phone|call|tel\b|tel[.:]|mobile|fax|telefon|llam|appel", NUMBERS),
    Kind("secret", rf"(?<![{_CODE}])[{_CODE}]{{{SECRET},}}+={{0,2}}+(?![{_CODE}=])", rf"[{_CODE}]{{{SECRET}}}", random_looking, 0.2, 0.2, r"(?i)token|secret|passw|api.?key|credential|bearer|auth", r"(?i)\b(?:commit|revision|checksum|digest|sha-?1|md5)\b"),
    Kind("key", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*+-----END [A-Z ]{0,40}PRIVATE KEY-----)", "AKIA|ASIA|gh[pousr]_|PRIVATE KEY-----", lambda m: F.lit(True)),
)
BASE = tuple(k.name for k in KINDS[:4])
_BLOCK = 128


def running(values: Column, add) -> Column:
    """Inclusive running totals of an array of counts under `add`, by blocks: n times the block length steps, and no array
    is grown one by one."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), add)

    def summed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = lambda t: F.transform(t, lambda x, i: total(F.slice(t, F.lit(1), i)))
        inside = lambda p: F.transform(v, lambda x, i: add(F.get(p, F.floor(i / _BLOCK).cast("int")), total(F.slice(v, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), i % _BLOCK + 1))))
        return let(let(blocks, before), inside)

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(summed(v)))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, x: a + x)


def surroundings(raw: Column, start: Column, end: Column) -> Column:
    """WINDOW characters before and after the bytes [start, end) of a text, whatever else is found in them.

    Cut by bytes, at most four a character, so a match costs the same wherever it is; what such a cut splits is further away.
    """
    before = F.substring(raw, (F.greatest(start - 4 * WINDOW, F.lit(0)) + 1).cast("int"), F.least(start, F.lit(4 * WINDOW)).cast("int"))
    after = F.substring(raw, (end + 1).cast("int"), F.lit(4 * WINDOW))
    return F.concat_ws(" ", F.right(before.cast("string"), F.lit(WINDOW)), F.left(after.cast("string"), F.lit(WINDOW)))


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """Array of struct(start, kind_rank, end, byte_start, byte_end, kind, score) of the confirmed matches."""

    def located(raw: Column, pieces: Column, found: Column) -> Column:
        size = F.size(found)
        steps = lambda length: F.transform(found, lambda m, i: (length(F.get(pieces, i)) + length(m)).cast("long"))

        def build(ends: Column, byte_ends: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                ok = kind.valid(m)
                score = F.lit(kind.score)
                if kind.checked:
                    near = surroundings(raw, F.get(byte_ends, i) - F.octet_length(m), F.get(byte_ends, i))
                    score = score + kind.checked + let(near, lambda n: F.when(n.rlike(kind.context), RAISE).otherwise(0.0) - F.when(n.rlike(kind.against), LOWER).otherwise(0.0))
                return F.struct(
                    (F.get(ends, i) - F.length(m)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"),
                    (F.get(byte_ends, i) - F.octet_length(m)).alias("byte_start"), F.get(byte_ends, i).alias("byte_end"),
                    F.lit(kind.name).alias("kind"), F.when(ok, score).otherwise(F.lit(0.0)).alias("score"),
                )

            return F.filter(F.transform(found, one), lambda s: s["score"] >= THRESHOLD)

        # A match that the validator drops still separates its neighbours, as it was consumed.
        return F.when(size == 0, none).otherwise(let(running_sums(steps(F.length)), lambda e: let(running_sums(steps(F.octet_length)), lambda b: build(e, b))))

    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,byte_start:bigint,byte_end:bigint,kind:string,score:double>>")
    split = let(text, lambda t: let(F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.split(t, kind.pattern, -1), lambda p: let(t.cast("binary"), lambda raw: located(raw, p, f))))))
    return F.when(text.rlike(kind.cheap), split).otherwise(none)


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with an array column of spans in order of start, then kind."""
    all_spans = F.concat(*[spans_of(body(text), k, i) for i, k in enumerate(KINDS)])
    return docs.withColumn(out, F.array_sort(all_spans))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by <KIND>; spans that overlap go together under the first one's kind.

    The text is cut by byte positions into what stands before each span and after the last, and put together once, so the
    cost is linear in it and in the spans.
    """
    piece = lambda raw, a, b: F.substring(raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).cast("string")

    def rebuilt(raw: Column, reach: Column) -> Column:
        """reach: how far the spans up to each one go."""

        def one(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))
            return F.when(s["byte_start"] >= at, F.concat(piece(raw, at, s["byte_start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

        return F.concat(F.array_join(F.transform(F.col(spans), one), ""), piece(raw, F.element_at(reach, -1), F.length(raw).cast("long")))

    spans = unused(docs, "spans")
    new = F.when(F.size(spans) > 0, let(F.col(text).cast("binary"), lambda raw: let(running(F.transform(F.col(spans), lambda s: s["byte_end"]), lambda a, x: F.greatest(a, x)), lambda reach: rebuilt(raw, reach)))).otherwise(F.col(text))
    return find(docs, text, spans).withColumn(text, new).select(*[F.col(f"`{c}`") for c in docs.columns])

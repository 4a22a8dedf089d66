"""Format-preserving pseudonyms for personal data, as DataFrame expressions only.

One pattern finds candidates; each is validated (Luhn for cards, ISO 7064 mod 97 for IBANs, octets,
calendar dates) and replaced by a keyed permutation of itself within its format, so equal values
get equal pseudonyms in every document and the result passes the same validation:

* strings are permuted by a Feistel network whose halves are the two halves of the string; every
  character is shifted inside its class (digit, small letter, capital, hexadecimal digit) by a
  keyed hash of the other half;
* dates and addresses are numbers and permuted as such, with cycle walking for dates;
* check digits are computed anew.

The rest of the text is untouched. Everything is an expression over one row: no shuffle, no Python.

Defined cases: null texts stay null and have no findings, empty ones stay empty; candidates that
fail validation stay as they are; of the parts of a run of digits (or of an IBAN's characters) that
start and end at separators, the leftmost longest valid one counts (a number that passes by chance
gives way to a card in printed groups that starts inside it); a candidate inside another one counts once, as the longest leading alternative of the pattern. Repeated rows are treated alike, very long texts whole;
an empty table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgraph.llm.common import hash_long
from panelgraph.llm.feistel import permute, permute_below, sides

ROUNDS = 6
DIGITS, SMALL, CAPITAL, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY, DAYS = "1900-01-01", 73049

#: The formats, as Java patterns; the first that fits at a place wins.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "secret": r"\b(?:[Pp]assword|[Tt]oken|[Ss]ecret|[Aa]pi_?[Kk]ey|PASSWORD|TOKEN|SECRET|API_?KEY)\b\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_\-]{8,}+",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    "date": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})\b",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]*[0-9])",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}\b|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
}
#: At the start of each group: the longest run in the format of an IBAN or a card from there. Validation decides which
#: part of it is one, so these two are searched as the valid values a text holds (see `numbers_in`).
RUN = rf"\b(?=({FORMATS['iban'][2:]}|{FORMATS['card'][2:].replace('18', '37')}))"
#: A card as issuers print it, after a separator: it goes before a number that passes by chance and overlaps its start.
PRINTED = r"[ -]((?:[3-6][0-9]{3}|2[2-7][0-9]{2})(?:[0-9]{9,15}|([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[ -][0-9]{6}[ -][0-9]{4,5}))\b"
PLAIN = "|".join(f"(?:{p})" for k, p in FORMATS.items() if k not in ("iban", "card"))
#: Holds in every text that one of the formats can match: the others have a digit or an @, a secret and a key need neither.
GATE = r"[0-9@]|AKIA|[=:]\s{0,3}\"?[A-Za-z_\-]{8}"


def _shift(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """c moved by `by` places round the first alphabet that holds it; other characters stay."""
    out = F.when(F.lit(False), c)
    for a in alphabets:
        at = F.position(c, F.lit(a))
        out = out.when(at > 0, F.substr(F.lit(a), ((at - 1 + by) % len(a) + 1).cast("int"), F.lit(1)))
    return out.otherwise(c)


def permute_text(s: Column, key: str, alphabets: tuple[str, ...] = (DIGITS, SMALL, CAPITAL)) -> Column:
    """A keyed permutation of the strings of one shape (length and class of each character)."""
    half = (F.length(s) / 2).cast("int")
    state = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"))

    def moved(a: Column, b: Column, k: Column) -> Column:
        by = F.array(F.when(F.length(b) > 64, F.sha2(b, 256)).otherwise(b))  # bound once, and short, so the work grows with the length only
        return F.transform(by, lambda h: F.array_join(F.transform(F.split(a, ""), lambda c, i: _shift(c, hash_long(key, k, i, h), alphabets)), ""))[0]

    def one(x: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(F.when(even, moved(x["l"], x["r"], k)).otherwise(x["l"]).alias("l"), F.when(even, x["r"]).otherwise(moved(x["r"], x["l"], k)).alias("r"))

    return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), state, one, lambda x: F.concat(x["l"], x["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of a digit string; the last digit is doubled if `doubled` is 0, else the one before it."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - 1 - i) % 2 == doubled, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def refill(shape: Column, digits: Column, kept: str = "[0-9]") -> Column:
    """The digits (or what `kept` matches) of shape replaced, in order, by those given; separators stay."""
    done = F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike(f"^{kept}$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return done["out"]


def card(m: Column, key: str) -> Column:
    """A number of 13 to 19 digits that passes Luhn, as another one; null if it does not pass."""
    d = _digits(m)
    body = permute_text(F.substr(d, F.lit(1), F.length(d) - 1), f"{key}:card", (DIGITS,))
    check = ((10 - luhn_sum(body, 0) % 10) % 10).cast("string")
    return F.when(luhn_sum(d, 1) % 10 == 0, refill(m, F.concat(body, check)))


def _mod97(s: Column) -> Column:
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(s, ""), F.lit(0), lambda r, c: (r * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + value(c)) % 97)


def _iban_sum(x: Column) -> Column:
    return _mod97(F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4))))


def iban(m: Column, key: str) -> Column:
    """An IBAN with right check digits, as another one of its country; null if they are wrong. Blanks stay."""
    x = F.replace(m, F.lit(" "), F.lit(""))
    land, body = F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(5))
    new = permute_text(body, f"{key}:iban", (DIGITS, CAPITAL))
    check = F.lpad((98 - _mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_iban_sum(x) == 1, refill(m, F.concat(land, check, new), "[A-Z0-9]"))


def numbers_in(text: Column) -> Column:
    """The distinct valid IBANs and cards of a text, longest first: runs in their format and the parts of runs that start and end at separators."""

    def passes(p: Column) -> Column:
        return luhn_sum(_digits(p), 1) % 10 == 0

    def hides(p: Column, run: Column) -> Column:
        printed = F.transform(F.sequence(F.lit(1), F.length(p)), lambda k: F.regexp_extract(F.substr(run, k), f"^{PRINTED}", 1))
        return ~F.concat(F.lit(" "), p).rlike(f"^{PRINTED}$") & F.exists(printed, lambda x: F.when(x != "", passes(x)).otherwise(False))

    def valid(p: Column, run: Column) -> Column:
        d = F.regexp_replace(p, "[ -]", "")
        is_card = F.when(F.length(d).between(13, 19) & passes(p), ~hides(p, run))
        return F.when(p.rlike("^[0-9]"), is_card).otherwise(F.when(F.length(d) >= 15, _iban_sum(d) == 1))

    def parts(run: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(13), F.length(run)), lambda n: F.substr(run, n, F.lit(2)).rlike("^[A-Z0-9][ -]?$"))
        return F.filter(F.transform(ends, lambda n: F.substr(run, F.lit(1), n)), lambda p: valid(p, run))

    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(RUN), F.lit(1)))
    found = F.array_distinct(F.flatten(F.transform(runs, parts)))
    return F.transform(F.sort_array(F.transform(found, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), False), lambda x: x["v"])


def pattern_of(numbers: Column) -> Column:
    """All formats as one pattern, with the given valid values in place of the formats of IBANs and cards."""
    return F.when(F.size(numbers) > 0, F.concat(F.lit(PLAIN + r"|\b(?:"), F.array_join(numbers, "|"), F.lit(r")\b"))).otherwise(F.lit(PLAIN))


def _slashed(m: Column, key: str) -> Column:
    """A date between slashes as another one; null if it is none in either notation.

    All strings that are a day of 1900 to 2099 as day/month or as month/day are numbered once: the former by
    their day, then those that only the latter reads (days above 12) in order. So the map is one permutation.
    """
    start = F.lit(FIRST_DAY).cast("date")
    inside = lambda x: F.when((x >= 0) & (x < DAYS), x)
    text = F.when(m.rlike("^../"), m)
    first = inside(F.datediff(F.try_to_date(text, "dd/MM/yyyy"), start).cast("long"))
    other = F.try_to_date(text, "MM/dd/yyyy")
    months = (F.year(other) - 1900) * 12 + F.month(other) - 1
    n = DAYS + DAYS - 12 * 2400  # 2400 months, in each 12 days that are read as day/month
    a, b = sides(n)
    x = F.coalesce(first, inside(F.datediff(other, start).cast("long")) - 12 * (months + 1) + DAYS)
    y = permute_below(x, F.lit(n).cast("long"), F.lit(a).cast("long"), F.lit(b).cast("long"), f"{key}:slashed")
    r = y - DAYS
    before = lambda k: F.datediff(F.add_months(start, k), start) - 12 * k  # days above 12 before month k
    guess = F.floor(r * 2400 / (DAYS - 12 * 2400)).cast("int")
    month = F.coalesce(*[F.when(before(guess + k) <= r, guess + k) for k in (2, 1, 0, -1, -2)])
    late = F.date_add(F.add_months(start, month), (12 + r - before(month)).cast("int"))
    return F.when(y < DAYS, F.date_format(F.date_add(start, y.cast("int")), "dd/MM/yyyy")).otherwise(F.date_format(late, "MM/dd/yyyy"))


def date(m: Column, key: str) -> Column:
    """A day of 1900 to 2099 as another one, in the same notation (slashes: in one of the two); null if there is no such day."""
    out = _slashed(m, key)
    a, b = sides(DAYS)
    for fmt, shape in (("dd.MM.yyyy", r"^..\."), ("yyyy-MM-dd", "^....-")):
        day = F.datediff(F.try_to_date(F.when(m.rlike(shape), m), fmt), F.lit(FIRST_DAY).cast("date")).cast("long")
        new = permute_below(F.when((day >= 0) & (day < DAYS), day), F.lit(DAYS).cast("long"), F.lit(a).cast("long"), F.lit(b).cast("long"), f"{key}:date")
        out = F.coalesce(F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), fmt), out)
    return out


def address(m: Column, key: str) -> Column:
    """An IPv4 address as another one; null if an octet is above 255."""
    o = [F.split(m, r"\.")[k].cast("long") for k in range(4)]
    n = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    new = permute(n, F.lit(65536).cast("long"), F.lit(65536).cast("long"), f"{key}:ip")
    part = lambda k: F.shiftright(new, k).bitwiseAND(255).cast("string")
    return F.when(F.greatest(*o) <= 255, F.concat_ws(".", part(24), part(16), part(8), part(0)))


def phone(m: Column, key: str) -> Column:
    """A number with its country code kept; first digits of groups in 2-9 stay there (as a digit of 8)."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    rest = F.substr(m, F.length(code) + 1)
    return F.concat(code, refill(rest, permute_text(_digits(rest), f"{key}:phone", (DIGITS,))))


def secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^.*[=:]\s*\"?", 0)
    body = F.substr(m, F.length(head) + 1)
    lower = body.rlike("^[0-9a-f]+$")
    return F.concat(head, F.when(lower, permute_text(body, f"{key}:secret", (HEX,))).otherwise(permute_text(body, f"{key}:secret")))


def email(m: Column, key: str) -> Column:
    """Another address; the top-level domain and the places of dots stay."""
    top = F.regexp_extract(m, r"\.[A-Za-z0-9-]+$", 0)
    return F.concat(permute_text(F.substr(m, F.lit(1), F.length(m) - F.length(top)), f"{key}:email"), top)


def kind_of(m: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(FORMATS.items()):
        out = F.when(m.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a candidate, or null if it is not valid."""
    key_ = lambda x: F.concat(F.lit("AKIA"), permute_text(F.substr(x, F.lit(5)), f"{key}:key"))
    ssn = lambda x: refill(x, permute_text(_digits(x), f"{key}:ssn", (DIGITS,)))
    does = {"email": email(m, key), "secret": secret(m, key), "key": key_(m), "iban": iban(m, key), "date": date(m, key), "ip": address(m, key), "ssn": ssn(m), "phone": phone(m, key), "card": card(m, key)}
    out = F.lit(None).cast("string")
    for name, x in does.items():
        out = F.when(kind == name, x).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, clean_text, n_pii, and findings: an array of (kind, value, pseudonym)."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text_"))
    rows = rows.withColumn("pattern_", pattern_of(F.when(F.col("text_").rlike("[0-9]"), numbers_in(F.col("text_")))))
    rows = rows.withColumn("found_", F.when(F.col("text_").rlike(GATE), F.regexp_extract_all("text_", "pattern_", F.lit(0))))
    named = F.transform("found_", lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    rows = rows.withColumn("named_", named)
    rows = rows.withColumn("done_", F.transform("named_", lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym"))))
    parts = F.split("text_", F.col("pattern_"), -1)
    glued = F.array_join(F.zip_with(parts, "done_", lambda p, x: F.concat(p, F.coalesce(x["pseudonym"], x["value"], F.lit("")))), "")
    valid = F.filter("done_", lambda x: x["pseudonym"].isNotNull())
    return rows.select(
        id_col,
        F.when(F.size("done_") > 0, glued).otherwise(F.col("text_")).alias("clean_text"),
        F.coalesce(F.when(F.size("done_") >= 0, F.size(valid)), F.lit(0)).cast("long").alias("n_pii"),
        F.coalesce(valid, F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")).alias("findings"),
    )

"""PII: format-preserving Feistel pseudonyms for validated numbers and dates.

A number is cut in two halves and sent through keyed Feistel rounds over decimal digits, so it is
permuted within its format: equal values get equal pseudonyms in every document, different values
of one format different ones, and whoever holds the key can go back.  Kinds:

* payment cards: 13 to 19 digits, blanks or hyphens between groups, Luhn-valid; all digits but the
  last are permuted and the check digit is set anew, so the pseudonym is Luhn-valid as well.  In a row of up to
  CHAIN digit groups every run of whole groups is tried, from the left, longest first; beside other numbers a
  pseudonym may by chance be read with them, so going back is sure for cards that stand alone only
* phone numbers: ``+`` country code and ten digits; the ten digits are permuted
* social security numbers: ``ddd-dd-dddd`` outside area 000, 666, 9xx, group 00, serial 0000
* IPv4 addresses: four octets of 0 to 255, permuted as one 32-bit number
* dates: ``yyyy-mm-dd`` and ``dd/mm/yyyy`` from 1900 to 2099 that exist, permuted as a day number

What is no number has no Feistel format: e-mail addresses and secrets (32 and more hex digits, small or capital) get
keyed digests in their own format, which are equal for equal values as well.

Built from Spark expressions only: one pattern finds all candidates; the text is split at them, each
is validated and mapped inside an array, and the parts are joined again.  No shuffle.

Defined results: null stays null, empty stays empty; what fails its validation stays as it is;
repeated rows are treated alike; rows and other columns stay, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
DAYS, FIRST_DAY = 73_049, "1900-01-01"
CHAIN = 10_000

# The patterns of candidates, in the order in which they are tried.  They begin where their kind of run begins and
# hold no repeated group that can be gone back into, so that a long run takes one sweep and no deep stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
    "phone": r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9])",
    "date": r"(?<![0-9])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
}
GROUP = "[0-9]{1,19}+(?![0-9])"
# a row of digit groups; it ends where a candidate of another kind begins
PATTERNS["card"] = rf"(?<![0-9])(?=[0-9](?:[ \-]?[0-9]){{12}}){GROUP}(?:[ \-](?!{'|'.join(f'(?:{p})' for p in PATTERNS.values())}){GROUP}){{0,{CHAIN - 1}}}+"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def keyed(key: str, tweak: str, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("bigint")


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: str, rounds: int = ROUNDS, back: bool = False) -> Column:
    """Rounds over a pair in [0, left_size) x [0, right_size): a struct (left, right). An even round
    adds a keyed number made of the right to the left, an odd one the other way round."""
    sign = -1 if back else 1

    def step(s, i):
        even = (i % 2) == 0
        return F.struct(
            F.when(even, F.pmod(s.left + sign * (keyed(key, tweak, i, s.right) % left_size), left_size)).otherwise(s.left).alias("left"),
            F.when(even, s.right).otherwise(F.pmod(s.right + sign * (keyed(key, tweak, i, s.left) % right_size), right_size)).alias("right"),
        )

    order = F.array(*[F.lit(i) for i in (range(rounds - 1, -1, -1) if back else range(rounds))])
    start = F.struct(left.cast("bigint").alias("left"), right.cast("bigint").alias("right"))
    return F.aggregate(order, start, step)


def permute_digits(number: Column, key: str, tweak: str, back: bool = False) -> Column:
    """A digit string of 2 to 36 digits to another of the same length; the length is part of the tweak."""
    n = F.length(number)
    a = (n / 2).cast("int")
    out = feistel(F.substr(number, F.lit(1), a), F.substr(number, a + 1), power_of_ten(a), power_of_ten(n - a), f"{key}#", tweak, back=back)
    return F.aggregate(F.array(out), F.lit(""), lambda _, s: F.concat(F.lpad(s.left.cast("string"), a, "0"), F.lpad(s.right.cast("string"), n - a, "0")))


def refill(shape: Column, number: Column) -> Column:
    """``shape`` with its digits replaced by those of ``number``, in order."""

    def step(acc, c):
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc.text, F.when(is_digit, F.substr(number, acc.at, F.lit(1))).otherwise(c)).alias("text"), (acc.at + is_digit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), step, lambda acc: acc.text)


def luhn_sum(number: Column, doubled: int) -> Column:
    """Luhn sum; ``doubled``: 1 if every second digit from the right, 0 if also the last, is doubled."""
    twice = lambda d: (2 * d) % 10 + F.when(d >= 5, 1).otherwise(0)
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when((i % 2) == doubled, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _one_card(m: Column, key: str, back: bool) -> Column:
    d = digits(m)
    body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", back)
    return refill(m, F.concat(body, F.pmod(-luhn_sum(body, 0), F.lit(10)).cast("string")))


def _card(m: Column, key: str, back: bool) -> Column:
    """A row of digit groups with the cards in it replaced: from each group on, the longest run of groups that is one."""
    groups, gaps = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), F.split(m, "[0-9]+", -1)

    def rows(_, parts):
        def run(i, j):
            return F.array_join(F.transform(F.sequence(i, j), lambda k: F.concat(F.when(k > i, F.get(parts.gaps, k)).otherwise(F.lit("")), F.get(parts.groups, k))), "")

        def is_card(d):
            return F.length(d).between(13, 19) & ((luhn_sum(d, 1) % 10) == 0)

        def step(acc, i):
            ends = F.filter(F.sequence(F.least(i + 18, F.size(parts.groups) - 1), i, F.lit(-1)), lambda j: is_card(digits(run(i, j))))

            def put(_, j):
                piece = F.when(j >= 0, _one_card(run(i, j), key, back)).otherwise(F.get(parts.groups, i))
                return F.struct(F.concat(acc.text, F.get(parts.gaps, i), piece).alias("text"), (F.greatest(i, j) + 1).alias("at"))

            return F.when(i < acc["at"], acc).otherwise(F.aggregate(F.array(F.coalesce(F.get(ends, F.lit(0)), F.lit(-1))), acc, put))

        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.size(parts.groups) - 1), start, step, lambda acc: acc.text)

    return F.aggregate(F.array(F.struct(groups.alias("groups"), gaps.alias("gaps"))), F.lit(""), rows)


def _phone(m: Column, key: str, back: bool) -> Column:
    d = digits(m)
    n = F.length(d)
    return refill(m, F.concat(F.substr(d, F.lit(1), n - 10), permute_digits(F.substr(d, n - 9), key, "phone", back)))


def _ssn(m: Column, key: str, back: bool) -> Column:
    """Areas are numbered 0 to 897 (001-665, 667-899), groups 0 to 98, serials 0 to 9998."""
    area, group, serial = (F.substring(m, p, n).cast("bigint") for p, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    out = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", back=back)

    def text(_, s):
        a = s.left + F.when(s.left > 664, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(s.right / 9999) + 1).cast("string"), 2, "0"), F.lpad((s.right % 9999 + 1).cast("string"), 4, "0"))

    return F.when(valid, F.aggregate(F.array(out), F.lit(""), text)).otherwise(m)


def _ipv4(m: Column, key: str, back: bool) -> Column:
    o = [F.split_part(m, F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3, 4)]
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ipv4", back=back)
    text = lambda _, s: F.concat_ws(".", *[x.cast("string") for h in (s.left, s.right) for x in (F.floor(h / 256), h % 256)])
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), F.aggregate(F.array(out), F.lit(""), text)).otherwise(m)


def _date(m: Column, key: str, back: bool) -> Column:
    """Day numbers are permuted in 271 x 271 = 73,441 cells; cells behind the last day are walked on from."""
    shape = F.when(F.substring(m, 5, 1) == "-", F.lit("yyyy-MM-dd")).otherwise(F.lit("dd/MM/yyyy"))
    iso = F.when(F.substring(m, 5, 1) == "-", m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    day = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("bigint")

    def once(_, d):
        return F.aggregate(F.array(feistel(F.floor(d / 271), d % 271, F.lit(271), F.lit(271), key, "date", back=back)), F.lit(0).cast("bigint"), lambda _, s: s.left * 271 + s.right)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.struct(day.alias("at"), F.lit(False).alias("done")), lambda acc, _: F.when(acc.done, acc).otherwise(F.aggregate(F.array(once(None, acc.at)), F.struct(acc.at.alias("at"), F.lit(False).alias("done")), lambda _, d: F.struct(d.alias("at"), (d < DAYS).alias("done")))))
    # 392 of 73,441 cells lie behind the last day: six steps in a row end there about once in 10^13; such a date stays
    text = F.aggregate(F.array(walked), m, lambda m, w: F.when(w["done"], F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), w["at"].cast("int")), "yyyy-MM-dd")).otherwise(iso))
    shaped = F.when(shape == "yyyy-MM-dd", text).otherwise(F.concat_ws("/", F.substring(text, 9, 2), F.substring(text, 6, 2), F.substring(text, 1, 4)))
    return F.when(day.between(0, DAYS - 1), shaped).otherwise(m)


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@mail.invalid"))


def _secret(m: Column, key: str) -> Column:
    base = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), m), 256)
    parts = lambda _, b: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(m) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("|", b, i.cast("string")), 256)), "")
    out = F.substr(F.aggregate(F.array(base), F.lit(""), parts), F.lit(1), F.length(m))
    return F.when(m.rlike("[A-F]") & ~m.rlike("[a-f]"), F.upper(out)).otherwise(out)


def pseudonym(m: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one candidate; ``back`` undoes the Feistel kinds (digests stay)."""
    full = lambda kind: m.rlike(f"^(?:{PATTERNS[kind].split('(?!')[0]})$")
    out = F.when(F.contains(m, F.lit("@")), m if back else _email(m, key))
    out = out.when(F.startswith(m, F.lit("+")), _phone(m, key, back))
    out = out.when(full("date"), _date(m, key, back))
    out = out.when(full("ssn"), _ssn(m, key, back))
    out = out.when(full("ipv4"), _ipv4(m, key, back))
    out = out.when(m.rlike("^[0-9A-Fa-f]{32,}$"), m if back else _secret(m, key))
    return out.otherwise(_card(m, key, back))


def pseudonymise_text(text: Column, key: str, back: bool = False) -> Column:
    found = F.regexp_extract_all(text, F.lit(ANY), 0)
    between = F.split(text, ANY, -1)
    new = F.transform(found, lambda m: pseudonym(m, key, back))
    joined = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(text.rlike("[0-9@]|[A-Fa-f]{32}"), joined).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced."""
    return docs.withColumn(text, pseudonymise_text(F.col(f"`{text}`"), key))


KEY = "corpus-pseudonyms-1"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every document's text with pseudonyms."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)

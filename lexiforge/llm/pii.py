"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one regex; those that pass their kind's check (a card's Luhn digit, an address's octets, a
social number's areas, a real date) are replaced, and one that fails is searched for parts of a usual form that pass; these are replaced in place by a keyed permutation of their own format: digits become
digits, letters become letters of the same case, separators stay, check digits are made anew, and dates stay dates.
The permutation is a Feistel network over the value's digits (or the day's number), so it is one-to-one, equal values
become equal pseudonyms in every document, and no table of values is kept.

Scale: a narrow expression on each row; no shuffle, no state.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import table

#: Kinds in the order in which a match is tried.
KINDS = ("email", "date", "ip", "ssn", "card", "phone")
_EDGE, _END = r"(?<![A-Za-z0-9._%+@-])", r"(?![A-Za-z0-9@])"
_DATE_END = r"(?:(?![A-Za-z0-9@])|(?=T[0-9]{2}:?[0-9]{2}))"  # a time may follow
_OK = r"[0-9](?![0-9]*+[A-Za-z@])"  # a digit of a group that ends well
#: One pattern for each kind; no group repeats without a bound unless possessively, where the engine loops and doesn't recurse; a run of characters is entered at its left edge only, so long runs cost linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "date": _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})" + _DATE_END,
    "ip": _EDGE + r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "card": _EDGE + rf"(?={_OK}(?:[ -]?{_OK}){{12}})[0-9]++(?![A-Za-z@])(?:[ -][0-9]++(?![A-Za-z@]))*+",
    "phone": r"(?<![A-Za-z0-9._%@-])(?:\+[0-9]{8,15}|(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4})" + _END,
}
CANDIDATE = "|".join(f"(?:{PATTERNS[k]})" for k in KINDS)
#: Forms of the parts that are tried in a candidate that fails as a whole; the last only at its start.
PARTS = (
    r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}",
    r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}",
    r"[0-9]{13,19}",
    r"[0-9]{4}([-/])[0-9]{2}\2[0-9]{2}",
    r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}",
    r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    r"(?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    r"[0-9](?:[ -]?[0-9]){12,18}",
)
#: Characters of a candidate that a part may take, and one more.
PART_WINDOW = 40
ROUNDS = 6
#: Days are numbered from this one; 400 Gregorian years have 146097 = 189 * 773 days, and a date stays in its 400 years.
#: Whole such cycles of years with four digits are 0200 to 9799; dates outside them stay.
FIRST_DAY, DAYS, DAY_LOW, CYCLES = "1800-01-01", 146097, 773, (-4, 19)
#: The Spark setting with the secret key; DEMO_KEY, known to all, stands in where it is unset, with a warning.
KEY_CONF, DEMO_KEY = "spark.lexiforge.pseudonyms.key", "lexiforge"


def _feistel(values: Column, radices: Column, tweak: Column, key: str) -> Column:
    """A keyed one-to-one map of int arrays to arrays of the same radices: alternate halves are shifted by a digest of the other."""
    half = F.floor(F.size(values) / 2).cast("int")
    left, right = F.slice(values, 1, half), F.slice(values, half + 1, F.size(values) - half)
    rl, rr = F.slice(radices, 1, half), F.slice(radices, half + 1, F.size(radices) - half)

    def shifted(own, bases, other, n):
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, n.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ",")).cast("binary"), 512)
        step = lambda i: F.conv(F.substr(digest, i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.transform(F.arrays_zip(own.alias("v"), bases.alias("r")), lambda x, i: (x["v"] + step(i)) % x["r"])

    def turn(s, n):
        return (
            F.when(n % 2 == 1, F.struct(s["a"].alias("a"), shifted(s["b"], rr, s["a"], n).alias("b")))
            .otherwise(F.struct(shifted(s["a"], rl, s["b"], n).alias("a"), s["b"].alias("b")))
        )

    start = F.struct(left.alias("a"), right.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def _class(c: Column) -> Column:
    """(radix, first code) of a character; radix 0: it stays."""
    code = F.ascii(c)
    kind = lambda r, b: F.struct(F.lit(r).alias("r"), F.lit(b).alias("b"))
    return F.when(code.between(48, 57), kind(10, 48)).when(code.between(97, 122), kind(26, 97)).when(code.between(65, 90), kind(26, 65)).otherwise(kind(0, 0))


def _permuted(text: Column, tweak: Column, key: str) -> Column:
    """text with its digits and letters permuted within their classes."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    live = F.filter(chars, lambda c: _class(c)["r"] > 0)
    values = F.transform(live, lambda c: F.ascii(c) - _class(c)["b"])
    new = _feistel(values, F.transform(live, lambda c: _class(c)["r"]), tweak, key)

    def rebuilt(values):
        def put(acc, c):
            kind = _class(c)
            there = kind["r"] > 0
            char = F.when(there, F.chr(F.get(values, acc["i"]) + kind["b"])).otherwise(c)
            return F.struct(F.concat(acc["s"], char).alias("s"), (acc["i"] + there.cast("int")).alias("i"))

        return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("i")), put, lambda acc: acc["s"])

    return F.get(F.transform(F.array(new), rebuilt), F.lit(0))  # a lambda binds the permuted values once


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last is the check digit."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.expr("0") + c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _day(match: Column) -> Column:
    """The date in any of the formats, else null."""
    iso = F.when(F.substr(match, F.lit(3), F.lit(1)) == ".", F.concat(F.substr(match, F.lit(7), F.lit(4)), F.lit("-"), F.substr(match, F.lit(4), F.lit(2)), F.lit("-"), F.substr(match, F.lit(1), F.lit(2)))).otherwise(F.replace(match, F.lit("/"), F.lit("-")))
    return iso.try_cast("date")


def _whole(kind: str) -> str:
    return "^(?:" + PATTERNS[kind].replace(_EDGE, "").replace(_DATE_END, "").replace(_END, "").replace("(?<![A-Za-z0-9._%+-])", "").replace("(?<![A-Za-z0-9._%@-])", "") + ")$"


def kind_of(match: Column) -> Column:
    """The kind of a candidate that passes its check, else null."""
    is_a = {k: match.rlike(_whole(k)) for k in KINDS}
    octets = F.forall(F.split(match, r"\."), lambda o: o.cast("int") <= 255)
    area = F.substr(match, F.lit(1), F.lit(3))
    ssn = ~area.isin("000", "666") & (area < "900") & (F.substr(match, F.lit(5), F.lit(2)) != "00") & (F.substr(match, F.lit(8), F.lit(4)) != "0000")
    days = F.date_diff(_day(match), F.lit(FIRST_DAY).cast("date"))
    n = F.length(_digits(match))
    return (
        F.when(is_a["email"], "email")
        .when(is_a["date"], F.when(F.coalesce(days.between(CYCLES[0] * DAYS, (CYCLES[1] + 1) * DAYS - 1), F.lit(False)), "date"))
        .when(is_a["ip"], F.when(octets, "ip"))
        .when(is_a["ssn"], F.when(ssn, "ssn"))
        .when(is_a["card"] & n.between(13, 19) & (_luhn_sum(_digits(match)) % 10 == 0), "card")
        .when(is_a["phone"] & n.between(8, 15), "phone")
    )


def _parts(match: Column) -> Column:
    """A failed candidate in pieces, array<struct<old, kind>>: from the left the parts of PARTS that pass, and what lies between.

    The candidate is cut into characters once, so each place costs the same however long the candidate is.
    """
    piece = "array<struct<old:string,kind:string>>"

    def pieces(chars):
        text = lambda a, n: F.array_join(F.slice(chars, a, n), "")
        between = lambda a, b: F.array(F.struct(text(a, b - a).alias("old"), F.lit(None).cast("string").alias("kind")))

        def tried(ahead, p):
            tries = [F.regexp_extract(ahead, f"^({form})(?![0-9])", 1) for form in PARTS[:-1]]
            tries.append(F.when(p == 1, F.regexp_extract(ahead, f"^({PARTS[-1]})(?![0-9])", 1)).otherwise(""))
            judged = F.transform(F.filter(F.array(*tries), lambda t: t != ""), lambda t: F.struct(t.alias("old"), kind_of(t).alias("kind")))
            return F.slice(F.filter(judged, lambda x: x["kind"].isNotNull()), 1, 1)

        def step(acc, c, p):
            def taken(hits):
                length = F.length(F.get(hits, F.lit(0))["old"])
                return F.struct((p + length).alias("next"), c.alias("last"), F.concat(acc["done"], between(acc["next"], p), hits).cast(piece).alias("done"))

            on = F.struct(acc["next"].alias("next"), c.alias("last"), acc["done"].alias("done"))
            starts = (p >= acc["next"]) & c.rlike("[0-9+(]") & ~acc["last"].rlike("[0-9]")
            hits = F.get(F.transform(F.array(text(p, F.lit(PART_WINDOW))), lambda ahead: tried(ahead, p)), F.lit(0))
            return F.when(starts, F.get(F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, taken(h)).otherwise(on)), F.lit(0))).otherwise(on)

        places = F.transform(chars, lambda c, i: F.struct(c.alias("c"), (i + 1).alias("p")))
        zero = F.struct(F.lit(1).alias("next"), F.lit("").alias("last"), F.array().cast(piece).alias("done"))
        return F.aggregate(places, zero, lambda acc, x: step(acc, x["c"], x["p"]), lambda acc: F.concat(acc["done"], between(acc["next"], F.size(chars) + 1)))

    return F.get(F.transform(F.array(F.filter(F.split(match, ""), lambda c: c != "")), pieces), F.lit(0))


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """The keyed pseudonym of a match of that kind, in the same format."""
    local = F.substring_index(match, "@", 1)
    domain = F.substring_index(match, "@", -1)
    email = F.concat(_permuted(local, F.lower(domain), key), F.lit("@"), domain)

    since = F.date_diff(_day(match), F.lit(FIRST_DAY).cast("date"))
    number = F.pmod(since, F.lit(DAYS))
    day = _feistel(F.array(F.floor(number / DAY_LOW).cast("int"), number % DAY_LOW), F.array(F.lit(DAYS // DAY_LOW), F.lit(DAY_LOW)), F.lit("date"), key)
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), since - number + F.get(day, F.lit(0)) * DAY_LOW + F.get(day, F.lit(1))).cast("string")
    date = (
        F.when(F.substr(match, F.lit(3), F.lit(1)) == ".", F.concat(F.substr(new, F.lit(9), F.lit(2)), F.lit("."), F.substr(new, F.lit(6), F.lit(2)), F.lit("."), F.substr(new, F.lit(1), F.lit(4))))
        .when(F.contains(match, F.lit("/")), F.replace(new, F.lit("-"), F.lit("/"))).otherwise(new)
    )

    octets = F.transform(F.split(match, r"\."), lambda o: o.cast("int"))
    ip = F.array_join(F.transform(_feistel(octets, F.transform(octets, lambda _: F.lit(256)), F.lit("ip"), key), lambda o: o.cast("string")), ".")

    part = lambda a, n: F.substr(match, F.lit(a), F.lit(n)).cast("int")
    areas = part(1, 3) - 1 - (part(1, 3) > 666).cast("int")
    social = _feistel(F.array(areas, part(5, 2) - 1, part(8, 4) - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), F.lit("ssn"), key)
    area = F.get(social, F.lit(0)) + 1
    ssn = F.format_string("%03d-%02d-%04d", area + (area >= 666).cast("int"), F.get(social, F.lit(1)) + 1, F.get(social, F.lit(2)) + 1)

    last = F.length(match)  # a card ends in its check digit; the first digit, the scheme's, stays
    body = F.substr(match, F.lit(2), last - 2)
    moved = F.concat(F.substr(match, F.lit(1), F.lit(1)), _permuted(body, F.lit("card"), key))
    card = F.concat(moved, (F.pmod(-_luhn_sum(F.concat(_digits(moved), F.lit("0"))), F.lit(10))).cast("string"))

    code = F.regexp_extract(match, r"^\+[0-9]{1,3}", 0)
    phone = F.concat(code, _permuted(F.substr(match, F.length(code) + 1), F.concat(F.lit("phone"), code), key))
    return F.when(kind == "email", email).when(kind == "date", date).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "card", card).otherwise(phone)


def secret(spark: SparkSession) -> str:
    """The secret key of the session's settings; without one a warning and DEMO_KEY, which protects nothing."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        warnings.warn(f"{KEY_CONF} is unset: pseudonyms are made with a public demonstration key", stacklevel=2)
    return key or DEMO_KEY


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its text rewritten and a column pii: array<struct<kind, new>> of the replacements in order.

    key is the secret; the same key gives the same pseudonyms in every run.  What fails its kind's check is
    searched for parts that pass (a card beside other digits) and stays else as it is, and so do all other characters; the length in code points is kept except where an octet's changes.  A null
    text stays null with no replacements; empty texts and an empty table give none; rows that repeat change alike;
    a column of docs that is called pii is replaced.
    """
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(F.col(text), CANDIDATE, -1)
    whole = lambda m, kind: F.array(F.struct(m.alias("old"), kind.alias("kind")))
    judged = F.transform(found, lambda m: F.get(F.transform(F.array(kind_of(m)), lambda k: F.when(k.isNull() & (F.length(m) > 8), _parts(m)).otherwise(whole(m, k))), F.lit(0)))
    changed = lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNull(), x["old"]).otherwise(pseudonym(x["old"], x["kind"], key)).alias("new"))
    replaced = F.transform(judged, lambda pieces: F.transform(pieces, changed))
    out = docs.withColumn("__new", F.when(F.col(text).rlike("[0-9@]") & (F.size(found) > 0), replaced))
    news = F.transform("__new", lambda pieces: F.array_join(F.transform(pieces, lambda x: x["new"]), ""))
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), news.alias("n")), lambda x: F.array(x["g"], F.coalesce(x["n"], F.lit(""))))), "")
    hits = F.coalesce(F.filter(F.flatten("__new"), lambda x: x["kind"].isNotNull()), F.array().cast("array<struct<kind:string,new:string>>"))
    rewritten = F.when(F.size(hits) > 0, joined).otherwise(F.col(text))
    return out.withColumns({"pii": hits, text: rewritten}).drop("__new")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: doc_id, the rewritten text, the number of replacements of each kind and in all."""
    done = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", "text", *[count(k) for k in KINDS], F.size("pii").cast("long").alias("n_pii"))

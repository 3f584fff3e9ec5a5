"""Format-preserving pseudonyms for numbers, dates and mail names, by keyed Feistel networks.

A validated value is turned into a number of its format's domain, permuted there, and written back
in the same layout. Each domain is a product of two parts, so an unbalanced Feistel network over the
parts is a permutation of exactly that domain, and different values keep different pseudonyms. The
permutation depends on key and format only: equal values are linked across documents, however they
are punctuated. Everything is a column expression.

Domains: card numbers of 12 to 19 digits (all but the check digit, which is computed anew), phone
numbers of ten digits (a country code stays), US social security numbers, IPv4 addresses, and days of the 400 years from
1700. In a mail address the letters and digits of the name are permuted within their classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.columns import LOWER, UPPER, named, unique_name

ROUNDS = 10
# Fixed formats. A value neither starts nor ends inside a longer run of digits or a word.
CARD = r"(?<![\w.-])\d(?:[ -]?\d){11,18}(?![\w-])"
# Ten digits with a sign or a separator that tells a phone number, and any layout of ten digits.
TOLD_PHONE = (r"(?<!\w)(?:\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?|(?:\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-]))"
              r"\d{3}[ .-]?\d{4}(?!\w)")
PHONE = r"(?<!\w)(?:\+?\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
SSN = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"
IPV4 = r"(?<![\w.-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w-]|\.\d)"
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w-]|\.\d)"
MAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Digits over single or several spaces and hyphens, in which card numbers are looked for.
RUN = r"(?<![\w.])\d[\d -]{10,}\d(?!\w)"
#: Formats that are found before card numbers.
TOLD = "|".join(f"(?:{p})" for p in (MAIL, DATE, IPV4, SSN, TOLD_PHONE))
#: All of them, without regard to what a run of digit groups holds.
ANY = "|".join(f"(?:{p})" for p in (MAIL, DATE, IPV4, SSN, TOLD_PHONE, CARD, PHONE))
FIRST_DAY = "1700-01-01"


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _below(digest: Column, m: Column) -> Column:
    """A number below m from the digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % m


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def luhn_sum(digits: Column) -> Column:
    """The check sum of a digit string whose last digit counts once."""
    n = F.length(digits)

    def weight(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + weight(i))


def _fill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.length(shape)),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("next")),
        lambda s, i: _bind(F.substr(shape, i, F.lit(1)), lambda c: F.when(
            c.between("0", "9"),
            F.struct(F.concat(s["out"], F.substr(digits, s["next"], F.lit(1))).alias("out"),
                     (s["next"] + 1).alias("next")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["next"].alias("next")))),
        lambda s: s["out"])
    return step


def _card(m: Column, key: str) -> Column:
    """The pseudonym of a card number with a right check digit."""
    def swap(d: Column) -> Column:
        n = F.length(d)
        low = F.floor((n - 1) / 2)
        a, b = F.pow(F.lit(10), low).cast("long"), F.pow(F.lit(10), n - 1 - low).cast("long")
        # the parts are read off the digits, so no division is needed
        new = permuted_parts(F.substr(d, n - low, low).cast("long"),
                             F.substr(d, F.lit(1), n - 1 - low).cast("long"), a, b, key,
                             F.concat(F.lit("card"), n.cast("string")))
        digits = _bind(new, lambda s: F.concat(
            F.lpad(s["r"].cast("string"), n - 1 - low, F.lit("0")),
            F.lpad(s["l"].cast("string"), low, F.lit("0"))))
        full = _bind(digits, lambda p: F.concat(
            p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))
        return _fill(m, full)

    return _bind(F.regexp_replace(m, r"\D", ""), swap)


def _is_card(m: Column) -> Column:
    """12 to 19 digits over single spaces or hyphens, not all zero, with a right check digit."""
    return F.when(
        m.rlike(r"^\d(?:[ -]?\d){11,18}[ -]*$"),
        _bind(F.regexp_replace(m, r"\D", ""),
              lambda d: (luhn_sum(d) % 10 == 0) & F.left(d, F.length(d) - 1).rlike("[1-9]")),
    ).otherwise(False)


def permuted_parts(left: Column, right: Column, a: Column, b: Column, key: str, form: Column
                   ) -> Column:
    """The permutation on the pair (left below a, right below b), as struct (l, r)."""
    def turn(s: Column, i: Column) -> Column:
        new_left = (s["l"] + _below(_digest(key, form, i, F.lit("l"), s["r"]), a)) % a
        return _bind(new_left, lambda new: F.struct(
            new.alias("l"),
            ((s["r"] + _below(_digest(key, form, i, F.lit("r"), new), b)) % b).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _part(c: Column, at: int, n: int) -> Column:
    return F.substring(c, at, n).cast("long")


def _padded(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _phone(m: Column, key: str) -> Column:
    def swap(d: Column) -> Column:
        ten = F.right(d, F.lit(10))
        new = permuted_parts(_part(ten, 1, 3), _part(ten, 4, 7), F.lit(1000), F.lit(10_000_000),
                             key, F.lit("phone"))
        out = _bind(new, lambda s: F.concat(_padded(s["l"], 3), _padded(s["r"], 7)))
        return _fill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), out))

    return _bind(F.regexp_replace(m, r"\D", ""), swap)


def _ssn(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = _part(m, 1, 3), _part(m, 5, 2), _part(m, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    slot = area - 1 - (area > 666).cast("long")
    new = permuted_parts(slot * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key,
                         F.lit("ssn"))

    def text(s: Column) -> Column:
        g = s["l"] % 99
        area0 = ((s["l"] - g) / 99).cast("long") + 1
        return F.concat_ws("-", _padded(area0 + (area0 >= 666).cast("long"), 3),
                           _padded(g + 1, 2), _padded(s["r"] + 1, 4))

    return F.when(valid, _bind(new, text)).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    def swap(p: Column) -> Column:
        o = [p[i].cast("long") for i in range(4)]
        valid = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256)
        new = permuted_parts(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65_536), F.lit(65_536),
                             key, F.lit("ipv4"))

        def text(s: Column) -> Column:
            parts = [x for h in ("l", "r") for x in (F.shiftright(s[h], 8), s[h] % 256)]
            return F.concat_ws(".", *[x.cast("string") for x in parts])

        return F.when(valid, _bind(new, text)).otherwise(m)

    return _bind(F.split(m, r"\."), swap)


def _date(m: Column, key: str) -> Column:
    """ISO, d.m.y, and m/d/y or d/m/y (the first that is a day); 146,097 = 189 * 773 days."""
    def swap(iso: Column) -> Column:
        day = F.try_to_timestamp(F.substring(iso, 1, 10), F.lit("yyyy-M-d")).cast("date")
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        valid = n.between(0, 146_096)
        new = permuted_parts(n % 189, ((n - n % 189) / 189).cast("long"), F.lit(189), F.lit(773),
                             key, F.lit("date"))
        out = _bind(F.date_add(F.lit(FIRST_DAY).cast("date"),
                               _bind(new, lambda s: (s["l"] + 189 * s["r"]).cast("int"))),
                    lambda d: F.when(m.contains("-"), F.date_format(d, "yyyy-MM-dd"))
                    .when(m.contains("."), F.date_format(d, "dd.MM.yyyy"))
                    .when(iso.endswith("m"), F.date_format(d, "MM/dd/yyyy"))
                    .otherwise(F.date_format(d, "dd/MM/yyyy")))
        return F.when(valid, out).otherwise(m)

    p = F.split(m, "[-/.]")
    two = [F.lpad(p[i], 2, "0") for i in (0, 1)]
    as_iso = F.when(m.contains("-"), F.concat(m, F.lit("i"))).when(
        m.contains("/") & (p[0].cast("int") <= 12),
        F.concat(p[2], F.lit("-"), two[0], F.lit("-"), two[1], F.lit("m"))
    ).otherwise(F.concat(p[2], F.lit("-"), two[1], F.lit("-"), two[0], F.lit("d")))
    return _bind(as_iso, swap)


def _shifted(text: Column, digest: Column) -> Column:
    """Every letter and digit moved on within its class by two digits of the digest."""
    def moved(i: Column) -> Column:
        by = F.conv(F.substr(digest, 2 * i - 1, F.lit(2)), 16, 10).cast("int")

        def one(c: Column) -> Column:
            out = c
            for letters in (LOWER, UPPER, "0123456789"):
                at = F.call_function("instr", F.lit(letters), c)
                out = F.when(at > 0, F.substr(F.lit(letters), (at - 1 + by) % len(letters) + 1,
                                              F.lit(1))).otherwise(out)
            return out

        return _bind(F.substr(text, i, F.lit(1)), one)

    return F.when(F.length(text) == 0, text).otherwise(F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(text)), moved), ""))


def _mail(m: Column, key: str) -> Column:
    def swap(parts: Column) -> Column:
        name = parts[0]
        half = F.floor(F.length(name) / 2).cast("int")

        def turn(s: Column, i: Column) -> Column:
            left = _shifted(s["l"], _digest(key, F.lit("mail"), i, F.lit("l"), s["r"]))
            return _bind(left, lambda new: F.struct(
                new.alias("l"),
                _shifted(s["r"], _digest(key, F.lit("mail"), i, F.lit("r"), new)).alias("r")))

        start = F.struct(F.substr(name, F.lit(1), half).alias("l"),
                         F.substr(name, half + 1, F.length(name)).alias("r"))
        new = F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn,
                          lambda s: F.concat(s["l"], s["r"]))
        return F.concat(new, F.lit("@"), parts[1])

    return _bind(F.split(m, "@"), swap)


def _plain(piece: Column) -> Column:
    return F.struct(piece.alias("old"), piece.alias("new"))


def _pieces(text: Column, pattern: str, found, between=lambda p: F.array(_plain(p))) -> Column:
    """The text as an array of (old, new): ``found`` of each match, ``between`` of what is around.

    Both give such arrays. A match starts and ends where no word goes on, so a piece can be looked
    at without its neighbours.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.flatten(F.zip_with(
        F.split(text, pattern, -1), matches,
        lambda p, m: F.concat(between(p), F.when(m.isNotNull(), found(m)).otherwise(F.array()))))


def told(m: Column, key: str) -> Column:
    """The pseudonym of one match of ``TOLD``; a value that fails its check stays as it is."""
    def whole(p: str) -> Column:
        return m.rlike(f"^(?:{p})$")

    return (
        F.when(m.contains("@"), _mail(m, key)).when(whole(DATE), _date(m, key))
        .when(whole(IPV4), _ipv4(m, key)).when(whole(SSN), _ssn(m, key)).otherwise(_phone(m, key))
    )


def _run(run: Column, key: str) -> Column:
    """Pieces of a run of digit groups.

    From left to right, the groups from here on whose joint number is a card number (the longest if
    there are several) are taken as one; what is left is searched for phone numbers.
    """
    def cut(groups: Column) -> Column:
        def joined(at: Column, n: Column) -> Column:
            return F.array_join(F.slice(groups, at, n), "")

        size = F.size(groups)
        # per group that starts a card number: its place and the number of groups
        starts = F.filter(F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
            i.alias("at"),
            F.get(F.filter(F.sequence(F.least(F.lit(19), size - i + 1), F.lit(1), F.lit(-1)),
                           lambda n: _is_card(joined(i, n))), F.lit(0)).alias("n"))),
            lambda s: s["n"].isNotNull())
        none = F.struct(F.lit(1).alias("next"),
                        F.array().cast("array<struct<at:int,n:int>>").alias("taken"))
        chosen = F.aggregate(starts, none, lambda c, s: F.when(
            s["at"] >= c["next"],
            F.struct((s["at"] + s["n"]).alias("next"),
                     F.concat(c["taken"], F.array(s)).alias("taken"))).otherwise(c),
            lambda c: c["taken"])

        def pieces(c: Column) -> Column:
            # a card number behind the groups since the one before; the last entry is the end
            ends = F.concat(c, F.array(F.struct((size + 1).alias("at"), F.lit(0).alias("n"))))
            return F.flatten(F.transform(ends, lambda s, k: _bind(
                F.when(k == 0, F.lit(1)).otherwise(
                    F.get(ends, k - 1)["at"] + F.get(ends, k - 1)["n"]),
                lambda at: F.concat(
                    _phones(joined(at, s["at"] - at), key),
                    F.when(s["n"] > 0, _bind(joined(s["at"], s["n"]), lambda m: F.array(
                        F.struct(m.alias("old"), _card(m, key).alias("new")))))
                    .otherwise(F.array())))))

        return _bind(chosen, pieces)

    return _bind(F.regexp_extract_all(run, F.lit(r"\d+[ -]*"), F.lit(0)), cut)


def _phones(text: Column, key: str) -> Column:
    return _pieces(text, PHONE, lambda m: F.array(
        F.struct(m.alias("old"), _phone(m, key).alias("new"))))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its text column rewritten, and ``n_pseudonyms``, the number of values changed.

    Null text stays null. Values that fail validation (a wrong check digit, an impossible day or
    octet) stay. Groups of digits may be read in several ways: what is told by its layout goes
    first, then card numbers at any borders of groups, then phone numbers. A column called
    ``n_pseudonyms`` is replaced; other columns are not looked at.
    """
    text = named(text_col)
    # a value has a digit, or an at sign
    worth = text.rlike("[0-9@]")
    pieces = _pieces(
        text, TOLD, lambda m: F.array(F.struct(m.alias("old"), told(m, key).alias("new"))),
        lambda p: _pieces(p, RUN, lambda m: _run(m, key), lambda q: _phones(q, key)))
    out = F.when(worth, _bind(pieces, lambda all_: F.struct(
        F.array_join(F.transform(all_, lambda s: s["new"]), "").alias("text"),
        F.size(F.filter(all_, lambda s: s["old"] != s["new"])).alias("n"))))
    made = unique_name("made")
    held = docs.withColumn(made, out)
    return held.withColumn(
        text_col, F.coalesce(F.col(f"{made}.text"), text)).withColumn(
        "n_pseudonyms", F.coalesce(F.col(f"{made}.n"), F.lit(0)).cast("long")).drop(made)

"""Column functions on identifiers, references, amounts, names and addresses; all of them JVM-side expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: The legal value-added tax rates and the parts of an order that an invoice may cover.
VAT_RATES = (0, 7, 10, 14, 20)
FRACTIONS = (2, 3, 4, 6, 12)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, however often ``use`` names it, and not at each place."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def money(c: Column) -> Column:
    """Two decimals, before any arithmetic."""
    return c.cast(MONEY)


def compact(c: Column) -> Column:
    """Without white space, hyphens and points; blank becomes null."""
    return F.nullif(F.regexp_replace(c, r"[\s\-.]+", ""), F.lit(""))


def normalize_id(c: Column) -> Column:
    """Tax and register numbers: without white space, hyphens, points and leading zeros; null when blank, 0 when all zeros."""
    bare = F.regexp_replace(compact(c), "^0+", "")
    return F.when(bare == "", "0").otherwise(bare)


def normalize_ice(c: Column) -> Column:
    """The 15-digit company identifier; leading zeros are significant."""
    return compact(c)


def valid_ice(c: Column) -> Column:
    return F.coalesce(normalize_ice(c).rlike("^[0-9]{15}$"), F.lit(False))


def match_reference(a: Column, b: Column) -> Column:
    """Whether two document references agree: punctuation, case and leading zeros aside, equal or one inside the other (four characters at least)."""
    bare = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"[\s\-_/.']+", ""), "^0+", ""))

    def agree(t: Column) -> Column:
        x, y = t["x"], t["y"]
        return (x == y) | F.when(F.length(x) < F.length(y), (F.length(x) >= 4) & F.contains(y, x)).otherwise((F.length(y) >= 4) & F.contains(x, y))

    return F.coalesce(once(F.struct(bare(a).alias("x"), bare(b).alias("y")), agree), F.lit(False))


def parse_amount(c: Column) -> Column:
    """French or English notation: the last of comma and point is the decimal mark, other marks group digits."""

    def plain(bare: Column) -> Column:
        comma, point = F.length(bare) - F.locate(",", F.reverse(bare)), F.length(bare) - F.locate(".", F.reverse(bare))
        has = lambda mark: F.contains(bare, F.lit(mark))
        return (
            F.when(has(",") & has(".") & (comma > point), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(has(",") & has("."), F.replace(bare, F.lit(","), F.lit("")))
            .otherwise(F.replace(bare, F.lit(","), F.lit(".")))
        )

    return once(F.regexp_replace(c, r"[^0-9,.\-]", ""), plain).try_cast(MONEY)


def words(c: Column) -> Column:
    """The distinct words of a name: lower case, letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def url_host(c: Column) -> Column:
    """Lower-case host without port and user; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def url_risk(c: Column) -> Column:
    """SAFE, UNSAFE (not https) or DANGEROUS (script, data or file address)."""
    return F.when(F.lower(F.trim(c)).rlike("^(javascript|data|file|vbscript):"), "DANGEROUS").when(F.lower(c).startswith("https://"), "SAFE").otherwise("UNSAFE")


def mask_personal_data(c: Column) -> Column:
    """E-mail addresses, 24-digit account numbers and 15-digit identifiers replaced by marks."""
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]")
    return F.regexp_replace(F.regexp_replace(c, r"\b[0-9]{24}\b", "[RIB]"), r"\b[0-9]{15}\b", "[ICE]")


#: Marks that decomposition leaves behind, and all characters that decompose into an ASCII letter or digit and such marks, with these.
MARKS = "".join(map(chr, range(0x300, 0x370)))
_DECOMPOSED = {chr(c): d[0] for c in range(0x80, 0x30000) if (d := unicodedata.normalize("NFD", chr(c)))[0] < "\x80" and d[0].isalnum() and all(x in MARKS for x in d[1:])}
ACCENTED, PLAIN = "".join(_DECOMPOSED), "".join(_DECOMPOSED.values())
#: Legal forms that are no part of a supplier's name, and words of a credit note.
LEGAL_FORMS = ("sarl", "sas", "sa", "sprl", "eurl", "sci", "gie")
CREDIT_NOTE = r"(?i)\b(avoir|annul|annulation|rectif|rectificatif|av-|cn-|credit\s*note|note\s*de\s*credit)\b"


def fold(c: Column) -> Column:
    """Lower case without marks: canonical decomposition as far as it gives ASCII letters and digits, in generated code."""
    return F.lower(F.translate(c, ACCENTED + MARKS, PLAIN))


def normalize_label(c: Column) -> Column:
    """Folded, everything but letters and digits as single spaces; empty for null."""
    return F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def normalize_code(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"[\s\-_|/.]+", ""))


def normalize_reference(c: Column) -> Column:
    """References of engagements: leading zeros stay."""
    return F.lower(F.regexp_replace(c, r"[\s\-_/.']+", ""))


def supplier_key(c: Column) -> Column:
    """A supplier's name without accents, marks and legal form; empty for null."""
    bare = F.regexp_replace(F.replace(fold(F.coalesce(c, F.lit(""))), F.lit("."), F.lit("")), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"\b({'|'.join(LEGAL_FORMS)})\b", " "), " +", " "))


def _tokens(label: Column, least: int = 1) -> Column:
    return F.filter(F.split(label, " "), lambda w: F.length(w) >= least)


def label_words(label: Column) -> Column:
    """The distinct words of two letters or more of a normalised label."""
    return F.array_distinct(_tokens(label, 2))


def labels_alike(x: Column, x_words: Column, y: Column, y_words: Column) -> Column:
    """Jaccard similarity of the words of two normalised labels; 1 for equal labels, 0 where one is blank."""
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(jaccard(x_words, y_words))


def label_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the words of two letters or more; 1 for equal labels, 0 where one is blank."""
    x, y = normalize_label(a), normalize_label(b)
    return labels_alike(x, label_words(x), y, label_words(y))


def same_person(a: Column, b: Column) -> Column:
    """Whether two names are likely one person's.

    Equal words; or a shared first or last word of three letters, and each other word of the shorter name is one of
    the longer or an initial of it (or the other way round); or six tenths of the words in common.
    """
    def both(t: Column) -> Column:
        x, y, family = t["x"], t["y"], t["family"]
        short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
        others = lambda t: F.filter(t, lambda w: w != family)
        near = lambda s, w: (s == w) | ((F.length(s) == 1) & w.startswith(s)) | ((F.length(w) == 1) & s.startswith(w))
        given = once(others(long), lambda more: (F.size(more) == 0) | F.forall(others(short), lambda s: F.exists(more, lambda w: near(s, w))))
        wide = lambda t: F.array_distinct(F.filter(t, lambda w: F.length(w) > 1))
        loose = once(F.struct(wide(x).alias("x"), wide(y).alias("y")), lambda w: (F.size(w["x"]) > 0) & (F.size(w["y"]) > 0) & (jaccard(w["x"], w["y"]) >= 0.6))
        equal = (F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)
        return F.when((F.size(x) == 0) | (F.size(y) == 0), False).when(equal, True).when(family.isNotNull(), given).otherwise(loose)

    edge = lambda t: F.filter(F.array(F.element_at(t, -1), F.element_at(t, 1)), lambda w: F.length(w) >= 3)
    family = lambda t: F.when((F.size(t["x"]) > 0) & (F.size(t["y"]) > 0), F.get(F.array_intersect(edge(t["x"]), edge(t["y"])), F.lit(0)))
    names = F.struct(once(normalize_label(a), _tokens).alias("x"), once(normalize_label(b), _tokens).alias("y"))
    return once(names, lambda t: once(F.struct(t["x"].alias("x"), t["y"].alias("y"), family(t).alias("family")), both))


def containment_bonus(a: Column, b: Column) -> Column:
    """0.80 to 0.95 where the shorter (four letters at least) is part of the longer, else 0."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return F.when((F.length(short) >= 4) & F.contains(long, short), F.lit(0.80) + F.lit(0.15) * F.length(short) / F.length(long)).otherwise(0.0)


def parse_amount_strict(c: Column) -> Column:
    """The variant of the typed rows: only blanks, letters and apostrophes are dropped, so other marks give null."""
    return once(F.regexp_replace(c, r"[\s\u00a0\u202fA-Za-z']", ""), lambda bare: F.when(bare.rlike(r"^-?[0-9.,]+$"), parse_amount(bare)))


def parse_amount_plain(c: Column) -> Column:
    """The variant of engagements: blanks are dropped and a comma is the decimal mark."""
    return F.replace(F.regexp_replace(c, r"[\s ]", ""), F.lit(","), F.lit(".")).try_cast(MONEY)


def parse_date(c: Column) -> Column:
    """ISO, or day, month and year apart by ``/``, ``-`` or ``.``; two-digit years are of this century; null if invalid."""
    t = F.trim(c)
    part = lambda i: F.regexp_extract(t, r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2}|\d{4})$", i)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    return F.coalesce(iso, F.when(part(1) != "", F.try_to_date(F.concat_ws("/", part(1), part(2), year), "d/M/yyyy")))


def parse_date_typed(c: Column) -> Column:
    """The variant of the typed rows: ISO, or day, month and year apart by ``/``, where a day beyond the end of its month is its last."""

    def read(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i)
        month = F.when(part(1).try_cast("int").between(1, 31), F.try_to_date(F.concat_ws("-", part(3), part(2), F.lit("1")), "yyyy-M-d"))
        day = once(month, lambda m: F.date_add(m, F.least(part(1).try_cast("int"), F.dayofmonth(F.last_day(m))) - 1))
        return F.coalesce(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")), day)

    return once(F.trim(c), read)


def parse_date_correction(c: Column) -> Column:
    """The variant of human corrections: also year first with slashes."""
    t = F.trim(c)
    return F.coalesce(parse_date(t), F.when(t.rlike(r"^\d{4}/\d{2}/\d{2}$"), F.try_to_date(t, "yyyy/MM/dd")))


def parse_bool(c: Column, numbers: bool = True) -> Column:
    """Yes and no in French and English; with ``numbers``, any number but 0 is yes; else null."""
    t = F.lower(F.trim(c))
    yes, no = ["true", "oui", "conforme", "o", "yes"], ["false", "non", "non conforme", "n", "no"]
    if not numbers:
        return F.when(t.isin(*yes, "y"), True).when(t.isin(*no), False)
    return F.when(t.isin(*yes), True).when(t.isin(*no), False).otherwise(t.try_cast("decimal(18,6)") != 0)


def is_credit_note(number: Column, ttc: Column, kind: Column | None = None) -> Column:
    """A negative total, or a word of a credit note in the number or the kind."""
    text = F.concat_ws(" ", number, *([] if kind is None else [kind]))
    return F.coalesce(ttc < 0, F.lit(False)) | text.rlike(CREDIT_NOTE)


def months_covered(begin: Column, end: Column, period: Column) -> Column:
    """Whole months from ``begin`` to the day after ``end``, one at least; else by the name of the period; else null."""
    after = F.date_add(end, 1)
    whole = F.lit(12) * (F.year(after) - F.year(begin)) + F.month(after) - F.month(begin) - F.when(F.day(after) < F.day(begin), 1).otherwise(0)
    t = F.lower(period)
    names = ["janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre"]
    named = sum((F.when(F.contains(t, F.lit(n)), 1).otherwise(0) for n in names), F.lit(0))
    by_name = F.when(t.rlike("t[1-4]"), 3).when(t.rlike("s[12]"), 6).otherwise(F.nullif(named, F.lit(0)))
    return F.when(begin.isNotNull() & end.isNotNull(), F.greatest(whole, F.lit(1))).otherwise(by_name).cast("int")


def period_price(price: Column, period: Column, months: Column, lengths: dict[str, int]) -> Column:
    """A price times the number of its periods in ``months``: by month, quarter, year or day (30 a month); else by month."""
    times = F.when(period == "JOURNALIER", (months * 30).cast("decimal(10,2)"))
    for name, length in lengths.items():
        times = times.when(period == name, F.round(months.cast("decimal(10,2)") / length, 2).cast("decimal(10,2)"))
    return (price * times.otherwise(months.cast("decimal(10,2)"))).cast(MONEY)


def verification_code(payload: Column) -> Column:
    """A query parameter's value, else the longest run of 12 hexadecimal digits or more, else the payload up to 64 characters."""
    t = F.trim(payload)
    named = F.nullif(F.regexp_extract(payload, r"(?i)(?:code|c|ref|token|verif(?:ication)?)=([^&#\s]+)", 1), F.lit(""))
    runs = F.regexp_extract_all(payload, F.lit("([0-9a-fA-F]{12,})"), 1)
    longest = F.aggregate(runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.coalesce(named, F.nullif(longest, F.lit("")), F.when((t != "") & (F.length(t) <= 64), t))


def payload_risk(payload: Column) -> Column:
    """ABSENT, DANGEROUS (control characters, malformed, another scheme, credentials), UNSAFE (http) or SAFE."""
    t = F.trim(payload)
    scheme = F.lower(F.regexp_extract(t, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    malformed = t.rlike(r"[\s<>\"{}|\\^`]") | ((scheme == "") & t.startswith(":"))
    return (
        F.when(F.coalesce(t == "", F.lit(True)), "ABSENT").when(t.rlike(r"[\x00-\x08\x0A-\x1F]"), "DANGEROUS").when(~t.rlike("[:/]"), "SAFE").when(malformed, "DANGEROUS")
        .when((scheme != "") & ~scheme.isin("http", "https"), "DANGEROUS").when(scheme == "http", "UNSAFE").when(t.rlike(r"^https://[^/?#]*@"), "DANGEROUS").otherwise("SAFE")
    )


def attestation_number(payload: Column) -> Column:
    """The certificate's number in a payload; null if there is none."""
    return F.nullif(F.regexp_extract(payload, r"\d{3,4}[\s|/\-]*\d{4}[\s|/\-]*\d{2,6}", 0), F.lit(""))

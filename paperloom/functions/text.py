"""Repair, comparison keys, tokens and patterns of Turkish and English report text, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# UTF-8 read as cp1252, in order of application.
MOJIBAKE = [
    ("Ä°", "İ"), ("Ä±", "ı"), ("ÄŸ", "ğ"), ("Ä\u009e", "Ğ"),
    ("ÅŸ", "ş"), ("Å\u009e", "Ş"), ("Ã§", "ç"), ("Ã‡", "Ç"),
    ("Ã¶", "ö"), ("Ã–", "Ö"), ("Ã¼", "ü"), ("Ãœ", "Ü"),
]
# cp1254 letters read as cp1252, and the letters whose presence shows that a text was read well.
CP1254 = ("ÝýÞþÐð", "İıŞşĞğ")
INTACT = "[şğıİŞĞ]"
# Ligatures and typographic characters.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("…", "...")]
TYPOGRAPHY = (
    "\u2018\u2019\u201b\u02bc" "\u201c\u201d\u201e" "\u2010\u2011\u2012\u2013\u2014\u2015" "\u00a0\u2007\u202f\u200b\u200c\u200d",
    "''''" '"""' "------" "      ",
)
# Letters followed by a detached accent.
DETACHED = [
    ("s[\u0327\u00b8\u0326]", "ş"),
    ("S[\u0327\u00b8\u0326]", "Ş"),
    ("c[\u0327\u00b8\u0326]", "ç"),
    ("C[\u0327\u00b8\u0326]", "Ç"),
    ("g[\u0306\u02d8]", "ğ"),
    ("G[\u0306\u02d8]", "Ğ"),
    ("o[\u0308\u00a8]", "ö"),
    ("O[\u0308\u00a8]", "Ö"),
    ("u[\u0308\u00a8]", "ü"),
    ("U[\u0308\u00a8]", "Ü"),
    ("I[\u0307\u02d9]", "İ"),
]
# Letters that the comparison key folds.
FOLDED = (
    "ıİIğĞşŞçÇöÖüÜâÂîÎûÛ",
    "iiiggssccoouuaaiiuu",
)
# Turkish abbreviations that do not end a sentence.
ABBREVIATIONS = "dr doç prof öğr gör arş yrd av sn vb vs bkz şek tab no nu sf çev ed".split()
# Patterns of text that a template left to be filled in.
PLACEHOLDERS = [
    r"\[\s*[^\]]{2,40}\s*\]", r"<[^>]{2,40}>", r"\bXX+\b", r"\.{4,}", r"(?i)\blorem ipsum\b", "(?i)\\bör(?:nek)?\\s*:",
]
# Titles of persons, without their stops.
TITLES = "prof doç dr öğr gör arş müh uzm av op".split()
# Patterns of sources that no academic index holds, and of local venues that few hold.
UNINDEXED = (
    r"(?iu)wikipedia|github\.com|kaggle|medium\.com|stackoverflow|\bblog\b|documentation|dokümantasyon|docs\b|tutorial|roboflow|ultralytics"
    r"|pytorch\.org|tensorflow\.org|opencv\.org|teknofest|\bveri seti\b|\bdataset\b|şartname|kılavuz|\bTÜİK\b|\bTUIK\b|bakanlığı|genel müdürlüğü"
)
LOCAL_VENUE = (
    r"(?iu)dergipark|tr\s*dizin|ulakbim|üniversitesi|university|institute of technology|enstitüsü|sempozyum|kurultay|kongresi"
    r"|teknik rapor|technical report|tech\.?\s*rep"
)
CAPITAL, SMALL = "A-ZÇĞİÖŞÜ", "a-zçğıöşü"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C, which Spark has no function for; texts that are in it already are only looked at."""
    return s.map(lambda x: x if x is None or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x))


#: Characters of which none can be out of normal form C, alone or beside another, and all others: a search for one of
#: these is several times faster than one for what is none of those.
STEADY = "\\x00-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
UNSTEADY = "\u0180-\u200f\u2028-\u202f\u205f-\u209f\u20c0-\U0010ffff"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` applied to `value`, which is computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _where(pattern: str, text: Column, use: Callable[[Column], Column]) -> Column:
    """`use` applied to texts in which `pattern` occurs; others are only looked at, once.

    The pattern may find more than `use` changes: a few wide ranges are tested faster than many letters.
    """
    return let(text, lambda t: F.when(t.rlike(pattern), use(t)).otherwise(t))


def _in_turn(text: Column, rules: list[tuple[str, str]], replace: Callable[..., Column]) -> Column:
    """The rules applied one after another; the plan names the replacement once, whatever their number."""
    pairs = F.array(*[F.struct(F.lit(a).alias("found"), F.lit(b).alias("put")) for a, b in rules])
    return F.aggregate(pairs, text, lambda t, r: replace(t, r["found"], r["put"]))


def _spelled(text: Column) -> Column:
    """Text with encoding damage, ligatures and typographic characters put right."""
    t = _where("[\u00c3-\u00c5]", text, lambda x: _in_turn(x, MOJIBAKE, F.replace))
    t = let(t, lambda x: F.when(x.rlike(f"[{CP1254[0]}]") & ~x.rlike(INTACT), F.translate(x, *CP1254)).otherwise(x))
    return _where("[\u00a0\u02bc-\uffff]", t, lambda x: F.translate(_in_turn(x, LIGATURES, F.replace), *TYPOGRAPHY))


def _repaired(text: Column, normal: bool) -> Column:
    t = _spelled(text)
    if not normal:
        # No replacement makes a character that may be out of normal form, so the text as it came tells whether one can occur.
        t = F.coalesce(nfc(F.when(text.rlike(f"[{UNSTEADY}]"), t)), t)
    return _where("[\u00a8\u00b8\u02d8-\u036f]", t, lambda x: F.regexp_replace(_in_turn(x, DETACHED, F.regexp_replace), "[\u0300-\u036f]", ""))


def repair(text: Column, normal: bool = False) -> Column:
    """Text with encoding damage, ligatures and detached accents put right, blanks collapsed, trimmed.

    `normal`: the text is known to be in normal form C, so that no Python runs.
    """
    return F.trim(F.regexp_replace(_repaired(text, normal), "[ \t]+", " "))


def damage(text: Column) -> Column:
    """Damaged places per 100 characters (texts under 100 count as 100)."""
    patterns = "|".join([a for a, _ in MOJIBAKE] + [p for p, _ in DETACHED])
    return F.regexp_count(text, F.lit(patterns)) / F.greatest(F.length(text) / 100, F.lit(1.0))


def fold(text: Column) -> Column:
    """Comparison key of text that is repaired already: folded, lower-case, only a-z, 0-9 and single blanks."""
    t = _where("[\u00c2-\u015f]", text, lambda x: F.translate(x, *FOLDED))
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def key(text: Column, normal: bool = False) -> Column:
    """Comparison key of text as it came; folding collapses blanks, so repair need not."""
    return fold(_repaired(text, normal))


def similarity(x: Column, y: Column) -> Column:
    """1 - edit distance / longer length of two comparison keys; two empty keys are equal."""
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(x, y) / F.nullif(longest, F.lit(0)))


def tokens(text: Column) -> Column:
    """Words of two characters or more; letters, digits, apostrophes and hyphens belong to a word."""
    return F.filter(F.split(text, "[^\\p{L}\\p{N}'’-]+"), lambda w: F.length(w) > 1)


def letters_only(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) > 1)


def lower_tr(text: Column) -> Column:
    """Turkish lower case: dotted and dotless i keep apart."""
    return F.lower(F.translate(text, "İI", "iı"))


def heading_number(line: Column) -> Column:
    """Struct (number, title) of a numbered heading; number is null without one."""
    pattern = rf"^((?:\d{{1,2}}[.)]){{1,3}}\d{{0,2}}|[IVXLC]{{1,5}}[.)]|[{CAPITAL}][.)])\s+(.*)$"
    number = F.regexp_replace(F.regexp_extract(line, pattern, 1), r"[.)]+$", "")
    found = line.rlike(pattern)
    return F.struct(F.when(found, number).alias("number"), F.when(found, F.trim(F.regexp_extract(line, pattern, 2))).otherwise(line).alias("title"))


def heading_level(number: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(number, r"\."), lambda x: x != "")), F.lit(1))


def sentences(text: Column) -> Column:
    """Sentences of over 20 characters; a stop after an abbreviation, or before a small letter, ends none."""
    flat = F.regexp_replace(text, r"\n+", " ")
    short = "|".join(ABBREVIATIONS)
    # Look-behind of bounded width: a stop that follows an abbreviation which is a whole word is no end.
    cut = rf"(?<=[.!?])(?<!(?iu:(?<!\p{{L}})(?:{short}))[.!?])\s+(?=[{CAPITAL}])"
    return F.filter(F.transform(F.split(flat, cut), lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def phrase_count(text_key: Column, phrase_key: Column) -> Column:
    """Occurrences of a phrase between blanks or ends; neighbours may share their blank."""
    doubled = F.concat(F.lit(" "), F.replace(text_key, F.lit(" "), F.lit("  ")), F.lit(" "))
    phrase = F.concat(F.lit(" "), F.replace(phrase_key, F.lit(" "), F.lit("  ")), F.lit(" "))
    rest = F.length(F.replace(doubled, phrase, F.lit("")))
    return F.when(phrase_key == "", 0).otherwise(F.floor((F.length(doubled) - rest) / F.length(phrase))).cast("long")


def placeholders(text: Column, most: int | None = None) -> Column:
    """Distinct places that a template left to be filled in, the first `most` of them where it is given; numeric citations are none."""
    found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda x: F.trim(x)) for p in PLACEHOLDERS])
    numeric = r"^\[\s*\d[\d\s,–-]*\]$"
    good = F.filter(found, lambda x: ~x.rlike(numeric) & (F.length(fold(x)) >= 2))
    return F.array_distinct(good) if most is None else F.slice(F.array_distinct(good), 1, most)


def citations(text: Column) -> Column:
    """Distinct numbers cited as [1], [1-3] or [1, 2-4]; spans of 100 or more are not expanded."""
    groups = F.regexp_extract_all(text, F.lit("\\[(\\d{1,3}(?:\\s*[-–,]\\s*\\d{1,3})*)\\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))

    def numbers(p: Column) -> Column:
        ends = F.regexp_extract_all(p, F.lit(r"\d{1,3}"), F.lit(0)).cast("array<int>")
        first, last = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        span = F.when((last >= first) & (last - first < 100), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.when(last.isNull(), F.array(first)).otherwise(span)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def author_citations(text: Column) -> Column:
    """Citations as "Author 2023", of "(Author ..., 2023)" and "Author (2023)"."""
    name, year = f"[{CAPITAL}][{SMALL}]+", "(?:19|20)\\d{2}"
    inside = F.regexp_extract_all(text, F.lit(rf"\(({name}(?:[^()]{{0,40}}?)[,;]?\s*{year})\)"), F.lit(1))
    after = F.regexp_extract_all(text, F.lit(rf"\b({name}\s*\({year})\)"), F.lit(1))
    both = lambda s: F.concat_ws(" ", F.regexp_extract(s, f"^({name})", 1), F.regexp_extract(s, f"({year})$", 1))
    return F.transform(F.concat(inside, after), both)


def reference_entry(line: Column) -> Column:
    """Struct of a bibliography entry: year, surname, link, doi, bare_link."""
    link = line.rlike(r"(?i)(https?://|www\.)")
    bare = F.trim(F.regexp_replace(line, r"(?i)(https?://|www\.)\S+", ""))
    year = F.regexp_extract(line, r"\b((?:19|20)\d{2})\b", 1)
    surname = F.regexp_extract(line, f"^[\"“]?([{CAPITAL}][{SMALL}]+)[,.\\s]", 1)
    return F.struct(
        F.when(year != "", year.cast("int")).alias("year"),
        F.nullif(surname, F.lit("")).alias("surname"),
        link.alias("link"),
        (line.rlike(r"\b10\.\d{4,}/\S+") | line.rlike(r"(?i)doi\s*:")).alias("doi"),
        (link & (F.size(tokens(bare)) < 4)).alias("bare_link"),
    )


def source_fields(line: Column) -> Column:
    """Struct of a bibliography entry: title, author (first surname or organisation), doi, unindexed, local_venue.

    The title is what stands in quotation marks, else the longest part between commas of four words or more.
    """
    quoted = F.regexp_extract(line, "[«\"“]([^»\"”]{10,300})[»\"”]", 1)
    parts = F.filter(F.transform(F.split(line, r",\s*"), lambda p: F.trim(p)), lambda p: (F.size(F.split(p, r"\s+")) >= 4) & ~p.rlike(r"^\(?\d{4}\)?$") & ~p.rlike(r"^pp?\.\s"))
    # Of parts of one length the first counts.
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.length(p)).alias("n"), i.alias("i"), p.alias("p"))))
    longest = F.trim(F.regexp_replace(F.get(ranked, F.lit(0))["p"], "[.;]$", ""))
    title = F.when(quoted != "", F.trim(F.regexp_replace(quoted, r"[,.;]\s*$", ""))).otherwise(longest)
    head = F.element_at(F.split(line, "[«\"“]"), 1)
    found = [
        F.regexp_extract(head, rf"(?:[{CAPITAL}]\.\s*){{1,3}}([{CAPITAL}][{SMALL}]{{2,}})", 1), F.regexp_extract(head, rf"^([{CAPITAL}][{SMALL}]{{2,}}),\s*[{CAPITAL}]\.", 1),
        F.regexp_extract(head, rf"^([{CAPITAL}][\w{CAPITAL}{SMALL}]+(?:\s+[{CAPITAL}][\w{CAPITAL}{SMALL}]+)?)", 1),
    ]
    doi = F.regexp_replace(F.regexp_extract(line, r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1), "[.,;]$", "")
    return F.struct(
        title.alias("title"),
        F.coalesce(*[F.nullif(x, F.lit("")) for x in found]).alias("author"),
        F.nullif(doi, F.lit("")).alias("doi"),
        line.rlike(UNINDEXED).alias("unindexed"),
        line.rlike(LOCAL_VENUE).alias("local_venue"),
    )


def source_flags(line: Column, year: Column, doi: Column, link: Column, bare_link: Column, this_year: int) -> Column:
    """Codes of what can be said of an entry without looking it up."""
    encyclopaedia = line.rlike("(?i)wikipedia")
    rules = [
        (year > this_year, "FUTURE_YEAR"), (encyclopaedia & (year >= this_year), "DATED_ENCYCLOPAEDIA"), (encyclopaedia & ~line.rlike("(?iu)erişim|accessed"), "NO_ACCESS_DATE"),
        (bare_link, "BARE_LINK"), (year.isNull() & ~doi & ~link, "NO_IDENTIFIER"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in rules]))


def short_name(name: Column, length: int = 14) -> Column:
    """The last word of a name without titles and what stands in parentheses; what is left without parentheses, or the name itself, if there is none; cut to
    `length` with an ellipsis."""
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))
    words = F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~lower_tr(F.replace(w, F.lit("."), F.lit(""))).isin(TITLES))
    one = F.coalesce(F.get(words, F.size(words) - 1), F.when(F.length(bare) > 0, bare).otherwise(F.trim(name)))
    return F.when(F.length(one) > length, F.concat(F.substring(one, 1, length - 1), F.lit("…"))).otherwise(one)


def excerpt(text: Column, length: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.rtrim(F.substring(flat, 1, length)), F.lit("…"))).otherwise(flat)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def access_code(text: Column) -> Column:
    """Letters and digits of a code, upper-case: what two spellings of it share."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def email(text: Column) -> Column:
    """Trimmed lower-case address, null if it is none."""
    e = F.lower(F.trim(text))
    return F.when(e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"), e)


def masked(text: Column, names: list[str], mask: str) -> Column:
    """`text` with each of `names` (three characters or more, longest first, any case) replaced."""
    import re

    usable = sorted((n for n in names if len(n) >= 3), key=len, reverse=True)
    return reduce(lambda t, n: F.regexp_replace(t, f"(?iu){re.escape(n)}", mask), usable, text)

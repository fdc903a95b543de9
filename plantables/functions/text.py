"""Scalar functions on course text: codes, credits, names, pages (F1-F26). Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
CODE = "(?<![0-9])([0-9]{8})(?![0-9])"
TRIPLE = r"^\s*([0-9]{1,2})\s*\(\s*([0-9]{1,2}|[xX])\s*-\s*([0-9]{1,2}|[xX])\s*-\s*([0-9]{1,2}|[xX])\s*\)\s*$"
#: Words that say there is no prerequisite.
NONE_WORDS = ["none", "no", "-", "ไม่มี"]
MOST_CREDITS = 12


def digits_as(c: Column, kind: str = "int") -> Column:
    """What a pattern found, digits or nothing, as a number; null for nothing, or where it is too large.

    A failed try_cast makes an exception with its message for each row, which
    costs more than all patterns of a line; most lines hold no number.
    """
    return F.nullif(c, F.lit("")).try_cast(kind)


def _nfc(form: str):
    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal


def normalize_text(c: Column, level: str = "basic") -> Column:
    """none, basic (NFC, one space), word (lower, ASCII digits) or strict (no white space); null is ''."""
    text = F.coalesce(c, F.lit(""))
    if level == "none":
        return text
    plain = F.regexp_replace(F.regexp_replace(_nfc("NFC")(text), "​", ""), " ", " ")
    text = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    if level == "basic":
        return text
    text = F.lower(F.translate(text, THAI_DIGITS, "0123456789"))
    return text if level == "word" else F.regexp_replace(text, r"(?U)\s+", "")


#: Texts that a worker holds as Python's at a time.
TEXTS = 256


@F.arrow_udf(T.StringType())
def canonical(s: pa.Array) -> pa.Array:
    """NFKC and case folded. A batch stays Arrow's, as Python's texts take several times its size."""
    folded = lambda part: pa.array([None if x is None else unicodedata.normalize("NFKC", x).casefold() for x in part.to_pylist()], pa.string())
    return pa.concat_arrays([folded(s[i : i + TEXTS]) for i in range(0, max(len(s), 1), TEXTS)])


def whole_word(c: Column, term: str) -> Column:
    """1 if the term stands with no ASCII letter, digit or underscore beside it; 0 for an empty term."""
    folded = unicodedata.normalize("NFKC", term).casefold()
    if not folded:
        return F.lit(0)
    quoted = "\\Q" + folded.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.coalesce(canonical(c).rlike(f"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])").cast("int"), F.lit(0))


def contains_ignoring_space(c: Column, term: str) -> Column:
    """1 if the text holds the term when white space doesn't count; 0 for an empty term."""
    bare = "".join(unicodedata.normalize("NFKC", term).casefold().split())
    if not bare:
        return F.lit(0)
    return F.coalesce(F.contains(F.regexp_replace(canonical(c), r"(?U)\s+", ""), F.lit(bare)).cast("int"), F.lit(0))


def course_codes(c: Column) -> Column:
    """all runs of exactly eight digits, in order."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(CODE), F.lit(1)), F.array().cast("array<string>"))


def _code_or_null(c: Column) -> Column:
    """Eight digits, or a wildcard (digits and x, 6 to 12 of them) made 8 long from the digits before its first x; white space aside."""
    bare = F.translate(F.lower(F.regexp_replace(c, r"(?U)\s+", "")), THAI_DIGITS, "0123456789")
    wild = F.when(F.length(bare) == 8, bare).otherwise(F.rpad(F.substring(F.regexp_extract(bare, "^[0-9]*", 0), 1, 8), 8, "x"))
    return F.when(bare.rlike("^[0-9]{8}$"), bare).when(bare.rlike("^x{6,12}$"), F.lit("x" * 8)).when(bare.rlike("^(?=.*x)[0-9x]{6,12}$"), wild)


def split_code_alternatives(c: Column) -> Column:
    """codes parted by "or" (English or Thai), line ends, commas or slashes; a part that is no code itself, by its spaces. Others are left out.

    Most cells are one code, or hold nothing that a code is made of, which
    one pattern tells; only the others are cut.
    """
    parts = F.split(F.coalesce(c, F.lit("")), r"(?i)\bor\b|หรือ|[\n,/]")
    each = F.transform(parts, lambda p: F.when(_code_or_null(p).isNotNull(), F.array(_code_or_null(p))).otherwise(F.filter(F.transform(F.split(p, r"(?U)\s+"), _code_or_null), lambda x: x.isNotNull())))
    return F.when(c.rlike(r"^[0-9]{8}\z"), F.array(c)).when(~c.rlike(f"[0-9xX{THAI_DIGITS}]"), F.array().cast("array<string>")).otherwise(F.flatten(each))


def placeholder_code(c: Column) -> Column:
    """a wildcard code with its prefix, eight X for one of X only, else null."""
    up = F.upper(F.trim(c))
    return F.when(up.rlike("^X+$"), "XXXXXXXX").when(up.rlike("^[0-9]+X+$"), F.concat(F.lit("PLACEHOLDER_"), up))


def is_real_code(c: Column) -> Column:
    """F8: eight digits."""
    return c.rlike("^[0-9]{8}$")


def parse_credits(c: Column) -> Column:
    """"3(2-2-5)" to credits and hours, x for an unknown hour, or a bare number; error for what can't be read or is over 12."""
    bare = F.regexp_extract(c, r"^\s*([0-9]{1,2})\s*$", 1)
    full = F.regexp_extract(c, TRIPLE, 1)
    credits = F.when(full != "", full).when(bare != "", bare).cast("int")
    good = credits <= MOST_CREDITS
    hour = lambda i: F.when(good, F.expr("int(null)") if i is None else digits_as(F.translate(F.regexp_extract(c, TRIPLE, i), "xX", "")))
    return F.struct(
        F.when(good, credits).alias("credits"), hour(2).alias("lecture"), hour(3).alias("lab"), hour(4).alias("self"), (c.isNotNull() & ~F.coalesce(good, F.lit(False))).alias("error")
    )


def format_credits(credits: Column, lecture: Column, lab: Column, self_: Column) -> Column:
    """back to "c(l-p-s)"; the plain number where an hour is missing."""
    whole = F.concat(credits.cast("string"), F.lit("("), lecture.cast("string"), F.lit("-"), lab.cast("string"), F.lit("-"), self_.cast("string"), F.lit(")"))
    return F.coalesce(whole, credits.cast("string"))


def normalize_credits_text(c: Column) -> Column:
    """credit texts found, without spaces, distinct, joined by " or "."""
    found = F.regexp_extract_all(F.regexp_replace(c, r"\s+", ""), F.lit(r"[0-9]{1,2}\([0-9xX]{1,2}-[0-9xX]{1,2}-[0-9xX]{1,2}\)"), F.lit(0))
    return F.array_join(F.array_distinct(found), " or ")


def credits_from_hours(lecture: Column, lab: Column, self_: Column) -> Column:
    """a third of all hours where that is whole, above 0 and at most 12."""
    total = lecture + lab + self_
    return F.when((total > 0) & (total % 3 == 0) & (total / 3 <= MOST_CREDITS), (total / 3).cast("int"))


def credits_match(a: Column, b: Column) -> Column:
    """equal without spaces; or equal leading numbers where not both have hours."""
    x, y = F.regexp_replace(F.coalesce(a, F.lit("")), r"\s+", ""), F.regexp_replace(F.coalesce(b, F.lit("")), r"\s+", "")
    lead = lambda v: F.regexp_extract(v, "^([0-9]+)", 1)
    return (x == y) | ((x != "") & (y != "") & ~(x.contains("(") & y.contains("(")) & (lead(x) != "") & (lead(x) == lead(y)))


def split_bilingual_name(c: Column) -> Column:
    """the last stretch that is Latin to the end becomes the second name; brackets left open or shut at their ends go."""
    second = F.regexp_extract(c, r"([A-Za-z][A-Za-z0-9 &,.'()#-]*)$", 1)
    first = F.trim(F.substr(c, F.lit(1), F.length(c) - F.length(second)))

    def trimmed(x: Column) -> Column:
        opened, shut = F.length(F.regexp_replace(x, r"[^(]", "")), F.length(F.regexp_replace(x, r"[^)]", ""))
        return F.trim(F.when(opened > shut, F.regexp_replace(x, r"\s*\(\s*$", "")).when(shut > opened, F.regexp_replace(x, r"^\s*\)|\)\s*$", "")).otherwise(x))

    return F.struct(trimmed(first).alias("first"), trimmed(F.trim(second)).alias("second"))


def join_wrapped_parts(parts: Column) -> Column:
    """F16: line pieces joined, with a space only where a digit touches the seam."""
    seam = lambda a, b: F.when(a.rlike("[0-9]$") | b.rlike("^[0-9]"), F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, b))
    return F.aggregate(parts, F.lit(""), lambda a, b: F.when(a == "", b).when(b == "", a).otherwise(seam(a, b)))


def stem_and_number(c: Column) -> Column:
    """a name without white space, and the number at its end."""
    bare = F.regexp_replace(c, r"\s+", "")
    return F.struct(F.regexp_replace(bare, "[0-9]+$", "").alias("stem"), digits_as(F.regexp_extract(bare, "([0-9]+)$", 1)).alias("number"))


def slot_number(c: Column) -> Column:
    """the number, 1 to 20, that a slot's name ends with before an "or"; else null."""
    head = F.trim(F.get(F.split(c, r"(?i)\bor\b|หรือ"), F.lit(0)))
    number = digits_as(F.regexp_extract(head, "([0-9]{1,9})$", 1))
    return F.when(number.between(1, 20), number)


def normalize_category(c: Column, aliases: dict[str, str]) -> Column:
    """a category by its other names, without spaces and case; others stay as they are."""
    bare = F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    known = [x for k, v in aliases.items() for x in (F.lit("".join(k.lower().split())), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*known), bare), F.trim(c)) if known else F.trim(c)


def pages_of_row(*columns: Column) -> Column:
    """the pages of the first of some columns that has any, each read as positive_pages, else by its numbers."""
    none = F.array().cast("array<int>")
    each = [F.when(F.size(positive_pages(c)) > 0, positive_pages(c)).otherwise(F.coalesce(loose_pages(c), none)) for c in columns]
    return F.coalesce(*(F.when(F.size(x) > 0, x) for x in each), none)


def normalize_prerequisite(c: Column) -> Column:
    """the distinct codes, sorted; '' for a word that says none."""
    codes = F.array_join(F.array_sort(F.array_distinct(course_codes(c))), " ")
    return F.when(F.lower(F.trim(c)).isin(NONE_WORDS), "").otherwise(F.coalesce(codes, F.lit("")))


def category_class(c: Column) -> Column:
    """free_elective, general_education or specialized, by keyword."""
    low = F.lower(c)
    return F.when(low.contains("free"), "free_elective").when(low.contains("general"), "general_education").when(low.isNotNull() & (low != ""), "specialized")


def positive_pages(c: Column) -> Column:
    """a JSON array to sorted distinct positive numbers; anything else is empty."""
    numbers = F.from_json(c, "array<int>")
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0))), F.array().cast("array<int>"))


def loose_pages(c: Column) -> Column:
    """F20, loose: every run of digits."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0))), F.array().cast("array<int>"))


def apply_spelling_map(c: Column, spelling: dict[str, str]) -> Column:
    """literal replacements, in the order given."""
    for a, b in spelling.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def is_subsequence(short: Column, long: Column) -> Column:
    """the characters of short stand in long in order. Letters and digits only count."""
    return F.coalesce(F.rlike(long, F.concat(F.lit("^.*"), F.regexp_replace(short, "(.)", "$1.*"))), F.lit(False))


def term_order(year: Column, semester: Column) -> Column:
    """a term as one number."""
    return year * 10 + semester


def term_label(year: Column, semester: Column) -> Column:
    """a term as text."""
    return F.concat_ws("/", year.cast("string"), semester.cast("string"))


def space_trailing_number(second: Column, first: Column) -> Column:
    """a space before a glued last number, where the first name ends with the same one."""
    n, m = F.regexp_extract(second, "([0-9]+)$", 1), F.regexp_extract(first, "([0-9]+)$", 1)
    return F.when((n != "") & (n == m) & second.rlike("[^0-9 ][0-9]+$"), F.regexp_replace(second, "([^0-9 ])([0-9]+)$", "$1 $2")).otherwise(second)


def pick_credits(table: Column, described: Column, derived: Column) -> Column:
    """the described value, but for a table list of alternatives that holds it; else the derived, else the table's."""
    return F.when(described.isNotNull() & table.contains(" or ") & table.contains(described), table).otherwise(F.coalesce(described, derived, table))


#: Fixed value: the primary script of names.
PRIMARY = r"[\x{0E00}-\x{0E7F}]"


#: Fixed value: what text recognition leaves before a second name: marks, or a torn number.
SECOND_JUNK = r"^(?:[\s#*\-•>]+|[0-9]{1,2}\s+(?=[A-Z]))+"


def _without(c: Column, noise: list[str]) -> Column:
    """Without noise phrases and credit fragments."""
    for phrase in noise:
        c = F.replace(c, F.lit(phrase), F.lit(" "))
    return F.regexp_replace(c, r"[0-9]{1,2}\s*\([0-9xX\s-]*\)", " ")


def _closed(c: Column) -> Column:
    """Without lone brackets, white space single."""
    out = F.regexp_replace(F.regexp_replace(c, r"\(([^()]*)$", "$1"), r"^([^()]*)\)", "$1")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def clean_name_primary(c: Column, noise: list[str]) -> Column:
    """without noise phrases, credit fragments, long Latin words but for one short last one, spaces within the primary script, and lone brackets; never empty."""
    out = F.regexp_replace(_without(c, noise), r"[A-Za-z]{4,}", " ")
    out = F.regexp_replace(out, rf"(?<={PRIMARY})\s+(?={PRIMARY})", "")
    return F.coalesce(F.nullif(_closed(out), F.lit("")), c)


def clean_name_secondary(c: Column, noise: list[str]) -> Column:
    """F15, second name: without marks and torn numbers before it, noise phrases, credit fragments and lone brackets; never empty."""
    out = F.regexp_replace(_closed(_without(c, noise)), SECOND_JUNK, "")
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), c)


def split_by_script(c: Column, n: int | Column) -> Column:
    """the lines of a cell in n pieces, a new one at each line after the first that begins in the primary script; null if they aren't n."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    joined = lambda done, x: F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit("\n"), x)))
    pieces = F.aggregate(lines, F.array().cast("array<string>"), lambda done, x: F.when((F.size(done) == 0) | x.rlike(rf"^\s*{PRIMARY}"), F.concat(done, F.array(x))).otherwise(joined(done, x)))
    return F.when(F.size(pieces) == n, pieces)

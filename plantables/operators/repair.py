"""Repair of extracted rows: dedupe, backfill, imputation on unanimous evidence only (R1-R30), and what descriptions tell.

Each changes a value only where all evidence agrees. `scope` columns keep
documents apart; `ordinal` is the order of rows in the document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantables.functions.text import CODE, digits_as, is_subsequence, slot_number


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def _filled(c: str) -> Column:
    return F.when(F.col(c).cast("string") != "", F.col(c))


def merge_chunks(rows: DataFrame, key: list[str], pages: str = "pages") -> DataFrame:
    """The first row of each key, with the pages of all."""
    rest = [c for c in rows.columns if c not in (*key, pages, "ordinal")]
    first = F.min_by(F.struct("ordinal", *rest), "ordinal").alias("__first")
    all_pages = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(pages, F.array().cast("array<int>"))))))
    return rows.groupBy(*key).agg(first, all_pages.alias(pages)).select(*key, "__first.*", pages)


def dedupe_fill(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """R2: one row a key with the first value that isn't empty of each field, in order."""
    values = [F.min_by(_filled(f), F.when(_filled(f).isNotNull(), F.col("ordinal"))).alias(f) for f in fields]
    return rows.groupBy(*key).agg(F.min("ordinal").alias("ordinal"), *values)


def suffix_wildcards(rows: DataFrame, by: list[str], fingerprint: list[str]) -> DataFrame:
    """R2: wildcard codes of a scope that stand for different things (fingerprints) are told apart as code, code_2, code_3..

    A thing whose name has a slot number (1 to 20) takes that; of several with
    one number the first in order. The others take the numbers left, in the
    order in which they first come. A code that ends with such a number stays.
    """
    wild = F.col("code").startswith("PLACEHOLDER_") & ~F.col("code").rlike("_[0-9]+$")
    things = rows.filter(wild).groupBy(*by, "code", *fingerprint).agg(F.min("ordinal").alias("__first"), F.min_by(slot_number(F.col("name")), "ordinal").alias("__asked"))
    mine = F.row_number().over(Window.partitionBy(*by, "code", "__asked").orderBy("__first")) == 1
    things = things.withColumn("__no", F.when(F.col("__asked").isNotNull() & mine, F.col("__asked")))
    whole = Window.partitionBy(*by, "code")
    nth = F.row_number().over(Window.partitionBy(*by, "code", F.col("__no").isNull()).orderBy("__first"))
    free = F.aggregate(F.array_sort(F.collect_set("__no").over(whole)), nth, lambda n, taken: F.when(taken <= n, n + 1).otherwise(n))
    numbered = things.withColumn("__no", F.coalesce("__no", free)).drop("__first", "__asked")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*by, "code", *fingerprint)]
    joined = rows.alias("r").join(numbered.alias("n"), reduce(lambda x, y: x & y, same), "left").select("r.*", "n.__no")
    return joined.withColumn("code", F.when(F.col("__no") > 1, F.concat_ws("_", "code", "__no")).otherwise(F.col("code"))).drop("__no")


def recover_codes(rows: DataFrame, known: DataFrame, least: int = 10, scope: Sequence[str] = ()) -> DataFrame:
    """A missing code, or one of digits but not eight, becomes that of the one known name that the row's name equals
    or ends with, white space aside, if the digits read stand in that code in order. Wildcards and letters are left.

    known(name, code), both within scope columns. Names shorter than `least` aren't used. recovered tells
    the changed rows, note what was done, or that several codes fit. Names are
    spread to their endings, so that this is a join on equal text.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    read = bare(F.col("code"))
    asked = rows.filter(read.rlike("^[0-9]*$") & (F.length(read) != 8)).select(*scope, read.alias("__read"), bare(F.col("name")).alias("__bare")).filter(F.length("__bare") >= least).distinct()
    ends = asked.withColumn("__end", F.explode(F.transform(F.sequence(F.lit(least), F.length("__bare")), lambda n: F.right(F.col("__bare"), n))))
    names = known.filter(F.col("code").rlike("^[0-9]{8}$")).select(*scope, bare(F.col("name")).alias("__end"), F.col("code").alias("__code")).filter(F.length("__end") >= least).distinct()
    fits = (F.col("__read") == "") | is_subsequence(F.col("__read"), F.col("__code"))
    found = ends.join(names, [*scope, "__end"]).filter(fits).groupBy(*scope, "__read", "__bare").agg(F.count_distinct("__code").alias("__n"), F.min("__code").alias("__code"))
    joined = rows.withColumns({"__read": read, "__bare": bare(F.col("name"))}).join(found, [*scope, "__read", "__bare"], "left")
    one = F.coalesce(F.col("__n") == 1, F.lit(False))
    note = F.when(one, F.concat(F.lit("code by name, was "), F.coalesce("code", F.lit("")))).when(F.col("__n") > 1, "name of several codes")
    return joined.withColumns({"recovered": one, "note": note, "code": F.when(one, F.col("__code")).otherwise(F.col("code"))}).drop("__bare", "__read", "__code", "__n")


def backfill(rows: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """An empty field takes the first filled one of its sibling rows; unanimous or not, the first in order."""
    w = Window.partitionBy(*key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumns({f: F.coalesce(_filled(f), F.first(_filled(f), ignorenulls=True).over(w)) for f in fields})


def fill_from_real(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Rows of an alternative group with one name take missing fields from another row of the same code outside groups."""
    real = rows.filter("alt_group is null").groupBy(*by, "code").agg(*(F.when(F.count_distinct(f) == 1, F.min(f)).alias(f"__{f}") for f in fields))
    names = rows.filter("alt_group is not null").groupBy(*by, "alt_group").agg((F.count_distinct("name") == 1).alias("__one"))
    joined = rows.join(real, [*by, "code"], "left").join(names, [*by, "alt_group"], "left")
    filled = joined.withColumns({f: F.when(F.col(f).isNull() & F.col("__one"), F.col(f"__{f}")).otherwise(F.col(f)) for f in fields})
    return filled.select(*rows.columns)


def vote_names(readings: DataFrame) -> DataFrame:
    """(code, name, source) -> the most frequent name without spaces and case; the description's on a tie; then by name.

    Empty readings don't count, nor those of a name that descriptions give to
    other codes only: they come from a row beside.
    """
    own = readings.withColumn("key", _bare(F.col("name"))).filter("key <> ''")
    described = own.filter("source = 'description'").select("key", F.col("code").alias("__of")).distinct()
    theirs = described.groupBy("key").agg(F.lit(True).alias("__taken"))
    mine = described.select("key", F.col("__of").alias("code"), F.lit(True).alias("__mine"))
    heard = own.join(theirs, "key", "left").join(mine, ["key", "code"], "left").filter("__taken is null or __mine")
    counted = heard.groupBy("code", "key").agg(F.count("*").alias("n"), F.max((F.col("source") == "description").cast("int")).alias("described"), F.min("name").alias("name"))
    best = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), F.desc("described"), "name"))
    return counted.withColumn("__r", best).filter("__r = 1").select("code", "name", "n")


def impute_from_neighbours(rows: DataFrame, prefix: int = 6, least: int = 3) -> DataFrame:
    """Missing credits become what at least `least` of the two codes before and after agree on, of the same prefix."""
    w = Window.partitionBy(F.substring("code", 1, prefix)).orderBy("code")
    near = F.array_compact(F.array(*(f("credits", n).over(w) for f in (F.lag, F.lead) for n in (1, 2))))
    found = rows.withColumn("__near", near)
    agreed = F.when((F.size("__near") >= least) & (F.size(F.array_distinct("__near")) == 1), F.col("__near")[0])
    return found.withColumn("imputed", F.col("credits").isNull() & agreed.isNotNull()).withColumn("credits", F.coalesce("credits", agreed)).drop("__near")


def impute_from_series(rows: DataFrame, by: list[str]) -> DataFrame:
    """Missing credits of a name, by the series of its stem (the name without the number at its end).

    Where all credits known of the series grow with the number by one unit
    ("..1" is 1(0-2-1), "..2" is 2(0-4-2)), a numbered row gets its own
    multiple; else what all of them agree on, but for a numbered row of a
    series of unlike units. Credits are texts; a name without a stem isn't in a series.
    """
    bare = F.regexp_replace(F.coalesce("name", F.lit("")), r"(?U)\s+", "")
    own = rows.withColumns({"__stem": F.regexp_replace(bare, "[0-9]+$", ""), "__no": digits_as(F.regexp_extract(bare, "([0-9]{1,4})$", 1))})
    # one pattern tells credits with hours, which are then cut
    part = lambda i: F.get("__parts", F.lit(i)).try_cast("int")
    hours = [part(i) for i in (1, 2, 3)]
    whole = (F.col("__no") > 0) & (part(0) == F.col("__no")) & (hours[0] % F.col("__no") == 0) & (hours[1] % F.col("__no") == 0) & (hours[2] % F.col("__no") == 0)
    unit = F.when(F.coalesce(whole, F.lit(False)), F.struct(*((h / F.col("__no")).cast("int").alias(n) for h, n in zip(hours, "abc", strict=True))))
    parts = F.when(F.col("credits").rlike(r"^[0-9]+\([0-9]+-[0-9]+-[0-9]+\)$"), F.split(F.translate("credits", "()", "-"), "-"))
    known = own.filter("credits <> '' and __stem <> ''").withColumn("__parts", parts).withColumn("__unit", unit)
    series = known.groupBy(*by, "__stem").agg(
        F.when(F.min("credits") == F.max("credits"), F.min("credits")).alias("__same"), (F.count("__unit") == F.count("*")).alias("__grows"), F.when(F.min("__unit") == F.max("__unit"), F.min("__unit")).alias("__unit")
    )
    joined = own.join(series, [*by, "__stem"], "left")
    times = [(F.col(f"__unit.{n}") * F.col("__no")).cast("string") for n in "abc"]
    grown = F.concat(F.col("__no").cast("string"), F.lit("("), times[0], F.lit("-"), times[1], F.lit("-"), times[2], F.lit(")"))
    numbered = F.col("__no").isNotNull() & F.col("__grows")
    value = F.when(numbered, F.when(F.col("__no") > 0, grown)).otherwise(F.col("__same"))
    lacks = F.coalesce("credits", F.lit("")) == ""
    return joined.withColumn("imputed", lacks & value.isNotNull()).withColumn("credits", F.when(lacks, F.coalesce(value, "credits")).otherwise(F.col("credits"))).drop("__stem", "__no", "__same", "__grows", "__unit")


def null_inferred(rows: DataFrame, keep: DataFrame, key: list[str]) -> DataFrame:
    """Inferred credits are unknown again unless the key is in the list to keep."""
    sure = keep.select(*key).distinct().withColumn("__keep", F.lit(True))
    joined = rows.join(sure, key, "left")
    return joined.withColumn("credits", F.when(F.col("inferred") & F.col("__keep").isNull(), F.lit(None)).otherwise(F.col("credits"))).drop("__keep")


def corroborated(rows: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Inferred rows that are what a single printed total leaves for them. totals(by, total)."""
    single = totals.groupBy(*by).agg(F.count("*").alias("n"), F.min("total").alias("total")).filter("n = 1").drop("n")
    group = F.coalesce("alt_group", F.concat(F.lit("x"), F.col("id")))
    once = rows.groupBy(*by, group.alias("g")).agg(F.max("credits").alias("credits"))
    sums = once.groupBy(*by).agg(F.sum("credits").alias("made"))
    return rows.filter("inferred").join(sums, by).join(single, by).filter("made = total").select(*by, "id")


def dissolve_mixed_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """An alternative group with more than one category is none. Rows without a group aren't shuffled for it."""
    mixed = rows.filter("alt_group is not null").groupBy(*by, "alt_group").agg((F.min("category") != F.max("category")).alias("__mixed")).filter("__mixed")
    joined = rows.join(mixed, [*by, "alt_group"], "left")
    return joined.withColumn("alt_group", F.when(F.col("__mixed").isNull(), F.col("alt_group"))).select(*rows.columns)


def last_term_only(rows: DataFrame, by: list[str]) -> DataFrame:
    """A code repeated in several terms of a scope stays in its last."""
    at = F.col("year") * 10 + F.col("semester")
    last = F.max(at).over(Window.partitionBy(*by, "code"))
    return rows.withColumn("__last", last).filter(at == F.col("__last")).drop("__last")


def post_clean(rows: DataFrame, by: list[str], listed: DataFrame) -> DataFrame:
    """Plan rows (by, ordinal, code, name, credits, alt_group, year, semester) with the rule that drops each, null for those that stay.

    In order: a placeholder whose name is a bare code; a numbered placeholder
    beside the one without the number, of its name and credits, in one term;
    a real code outside groups in several terms, but for one row of its last;
    listed(code) ones. The second looks at rows that the first leaves.
    """
    term = [*by, "year", "semester"]
    held = F.col("code").startswith("PLACEHOLDER")
    bare = held & F.col("name").rlike("^[0-9xX]{4,}$")
    twins = rows.filter(held & ~bare).select(*term, F.col("code").alias("__stem"), F.col("name").alias("__name"), F.col("credits").alias("__credits")).distinct()
    own = rows.withColumn("__stem", F.when(held & F.col("alt_group").isNull() & F.col("code").rlike("_[0-9]+$"), F.regexp_replace("code", "_[0-9]+$", "")))
    met = own.filter("__stem is not null").join(twins, [*term, "__stem"]).filter(F.col("name").eqNullSafe(F.col("__name")) & F.col("credits").eqNullSafe(F.col("__credits"))).select(*by, "ordinal").distinct().withColumn("__twin", F.lit(True))
    at = F.col("year") * 10 + F.col("semester")
    real = rows.filter(~held & F.col("alt_group").isNull())
    several = real.groupBy(*by, "code").agg(F.max(at).alias("__last"), F.min(at).alias("__first"), F.max_by("ordinal", F.struct(at, -F.col("ordinal"))).alias("__kept")).filter("__first < __last").select(*by, "code", "__kept")
    marked = rows.join(met, [*by, "ordinal"], "left").join(several, [*by, "code"], "left").join(F.broadcast(listed.select("code").distinct().withColumn("__listed", F.lit(True))), "code", "left")
    earlier = ~held & F.col("alt_group").isNull() & (F.col("__kept") != F.col("ordinal"))
    rule = F.when(bare, "bare code").when(F.col("__twin"), "numbered copy").when(earlier, "earlier term").when(F.col("__listed"), "listed")
    return marked.withColumn("rule", rule).select(*rows.columns, "rule")


def used_placeholders(course: DataFrame, plan: DataFrame) -> DataFrame:
    """Courses but for placeholders that the plan doesn't use."""
    held = F.col("code").startswith("PLACEHOLDER")
    return course.filter(~held).unionByName(course.filter(held).join(plan.select("code"), "code", "left_semi").select(*course.columns))


def drop_junk(rows: DataFrame, junk: str) -> DataFrame:
    """Rows whose name is a total, or only a code with credits."""
    return rows.filter(~F.col("name").rlike(junk) & ~F.col("name").rlike(r"^[0-9]{8}(\s+[0-9]+\([^)]*\))?$"))


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Reviewed corrections by key: `drop` takes a row out, and given fields replace its own."""
    given = overrides.select(*key, F.col("drop").alias("__drop"), *(F.col(f).alias(f"__{f}") for f in fields))
    joined = rows.join(given, key, "left").filter(~F.coalesce("__drop", F.lit(False)))
    return joined.withColumns({f: F.coalesce(f"__{f}", f) for f in fields}).select(*rows.columns)


def order_slots(rows: DataFrame, by: list[str]) -> DataFrame:
    """The place of each row among those of its wildcard code, by page, then by where its name stands there."""
    at = F.row_number().over(Window.partitionBy(*by, "code").orderBy(F.col("page").asc_nulls_last(), F.instr("page_text", F.col("name")), "ordinal"))
    return rows.withColumn("place", at)


def longest_of_series(rows: DataFrame, by: list[str], field: str) -> DataFrame:
    """The longest text of a series, for the rows whose own words are among its words."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.length(field)), field)
    best = F.first(field).over(w)
    own = rows.withColumn("__best", best)
    within = F.size(F.array_except(F.split(field, " "), F.split("__best", " "))) == 0
    return own.withColumn(field, F.when(within, F.col("__best")).otherwise(F.col(field))).drop("__best")


def description_prerequisites(lines: DataFrame, label: str = r"(?i)prerequisite\s*:(.*)$") -> DataFrame:
    """D3: (doc_id, code, line_no, line) -> by code the codes of its first prerequisite line that has some, else ''."""
    found = lines.withColumn("text", F.regexp_extract("line", label, 1)).filter(F.col("line").rlike(label))
    codes = F.array_join(F.regexp_extract_all("text", F.lit(CODE), F.lit(1)), " ")
    each = found.select("doc_id", "code", "line_no", codes.alias("codes"))
    return each.groupBy("doc_id", "code").agg(F.coalesce(F.min_by("codes", F.when(F.col("codes") != "", F.col("line_no"))), F.lit("")).alias("prerequisite"))


def apply_prerequisites(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The prerequisite of matching rows is replaced, and pages are joined."""
    given = found.select(*key, F.col("prerequisite").alias("__p"), F.col("pages").alias("__pages"))
    none = F.array().cast("array<int>")
    joined = rows.join(given, key, "left")
    pages = F.array_sort(F.array_union(F.coalesce("pages", none), F.coalesce("__pages", none)))
    return joined.withColumn("prerequisite", F.coalesce("__p", "prerequisite")).withColumn("pages", pages).drop("__p", "__pages")


def terms_by_group(courses: DataFrame, slots: DataFrame) -> DataFrame:
    """(doc_id, code, grp) of courses outside the plan: terms of the document's slots (doc_id, grp, term) whose group is
    theirs, or holds theirs or is held by it, white space aside. A document has few groups."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    asked = courses.select("doc_id", bare(F.col("grp")).alias("__g")).filter("__g <> ''").distinct()
    given = slots.select("doc_id", bare(F.col("grp")).alias("__s"), "term").filter("__s <> ''").distinct()
    met = asked.join(given, "doc_id").filter(F.contains("__g", "__s") | F.contains("__s", "__g"))
    terms = met.groupBy("doc_id", "__g").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))
    return courses.withColumn("__g", bare(F.col("grp"))).join(terms, ["doc_id", "__g"]).select("doc_id", "code", "terms")


def terms_by_prefix(courses: DataFrame, slots: DataFrame, least: int = 5) -> DataFrame:
    """Terms of all slots whose code prefix (digits before the wildcard, `least` or more) a course code starts with.

    Codes are spread to their prefixes, so that this is a join on equal keys.
    """
    prefixes = slots.select(F.regexp_extract("code", "([0-9]+)X*$", 1).alias("prefix"), "term").filter(F.length("prefix") >= least).distinct()
    spread = courses.select("code", F.explode(F.transform(F.sequence(F.lit(least), F.lit(8)), lambda n: F.substr("code", F.lit(1), n))).alias("prefix")).distinct()
    return spread.join(prefixes, "prefix").groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))


def only_in(rows: DataFrame, by: str, one, other) -> DataFrame:
    """Codes that one variant has and the other doesn't."""
    return rows.filter(F.col(by) == one).select("code").distinct().join(rows.filter(F.col(by) == other).select("code"), "code", "left_anti")


def category_by_prefix(courses: DataFrame, rows: DataFrame, prefix: int = 5) -> DataFrame:
    """A course's own category, else the one that most real codes of its prefix have; ties to the first by name."""
    counts = rows.filter(F.col("code").rlike("^[0-9]{8}$") & F.col("category").isNotNull()).groupBy(F.substring("code", 1, prefix).alias("prefix"), "category").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("n"), "category"))
    top = counts.withColumn("__r", best).filter("__r = 1").select("prefix", F.col("category").alias("__most"))
    joined = courses.withColumn("prefix", F.substring("code", 1, prefix)).join(top, "prefix", "left")
    return joined.withColumn("category", F.coalesce("category", "__most")).drop("__most", "prefix")


#: Fixed value: words of names and groups that one chooses from.
CHOICE_WORDS = r"(?i)elective|เลือก"


def category_for_code(rows: DataFrame, known: DataFrame, keywords: dict[str, str], prefixes: dict[str, str], prefix: int = 5) -> DataFrame:
    """Category and type of rows (code, name, group, alt_group, year, semester, category).

    The category is the row's own, else the majority of its prefix in `known`
    (category_by_prefix), else that of the first keyword in its name, else of
    the first prefix it begins with. The type is required for a real code in
    an alternative group of a term; elective for a wildcard, or where the
    group, or the name of a row without a group, says so; required else.
    """
    found = category_by_prefix(rows, known, prefix)
    said = [F.when(F.contains("name", F.lit(word)), value) for word, value in keywords.items()]
    begins = [F.when(F.startswith("code", F.lit(start)), value) for start, value in prefixes.items()]
    wild = ~F.coalesce(F.col("code").rlike("^[0-9]{8}$"), F.lit(False))
    pair = F.col("alt_group").isNotNull() & F.col("year").isNotNull() & F.col("semester").isNotNull() & ~wild
    chosen = F.coalesce(F.coalesce("group", "name").rlike(CHOICE_WORDS), F.lit(False))
    kind = F.when(pair, "required").when(wild | chosen, "elective").otherwise("required")
    return found.withColumns({"category": F.coalesce("category", *said, *begins), "type": kind})


def vote_printed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows(doc_id, code, name): the spelling that the document prints most, twice or more and alone, replaces a code's others.

    Counted without white space and case. A code with a spelling that holds
    another is left alone.
    """
    spelt = rows.select("doc_id", "code", _bare(F.col("name")).alias("key")).filter("key <> ''").distinct()
    a, b = spelt.alias("a"), spelt.select("doc_id", "code", F.col("key").alias("other")).alias("b")
    twice = a.join(b, ["doc_id", "code"]).filter("key <> other")
    nested = twice.filter(F.contains("key", "other")).select("doc_id", "code").distinct()
    asked = twice.select("doc_id", "code", "key").distinct().join(nested, ["doc_id", "code"], "left_anti")
    text = docs.select("doc_id", _bare(F.col("text")).alias("__text"))
    times = ((F.length("__text") - F.length(F.replace("__text", F.col("key"), F.lit("")))) / F.length("key")).cast("long")
    counted = asked.join(text, "doc_id").select("doc_id", "code", "key", times.alias("n"))
    w = Window.partitionBy("doc_id", "code")
    best = counted.withColumn("__most", F.max("n").over(w)).filter("n = __most and n >= 2").withColumn("__ties", F.count("*").over(w)).filter("__ties = 1").select("doc_id", "code", F.col("key").alias("__best"))
    shown = rows.groupBy("doc_id", "code", _bare(F.col("name")).alias("__best")).agg(F.min("name").alias("__name"))
    joined = rows.join(best, ["doc_id", "code"], "left").join(shown, ["doc_id", "code", "__best"], "left")
    return joined.withColumn("name", F.coalesce("__name", "name")).select(*rows.columns)


def resolve_orphans(rows: DataFrame, index: DataFrame, known: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """Rows without a code get it from the index of unique names, else from known rows, else from a keyword, else from the
    known wildcard row (the least code) of the same series stem; tier tells which, null for none."""

    def unique(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(_bare(F.col("name")).alias("__k")).agg(F.when(F.count_distinct("code") == 1, F.min("code")).alias(name))

    word = F.coalesce(*(F.when(F.lower("name").contains(k), v) for k, v in keywords.items())) if keywords else F.lit(None).cast("string")
    stem = lambda c: F.regexp_replace(_bare(c), "[0-9]+$", "")
    series = known.filter(F.lower("code").contains("x")).groupBy(stem(F.col("name")).alias("__stem")).agg(F.min("code").alias("__four")).filter("__stem <> ''")
    joined = rows.withColumns({"__k": _bare(F.col("name")), "__stem": stem(F.col("name"))}).join(unique(index, "__one"), "__k", "left").join(unique(known, "__two"), "__k", "left").join(series, "__stem", "left").withColumn("__three", word)
    found = ["__one", "__two", "__three", "__four"]
    tier = F.coalesce(*(F.when(F.col(c).isNotNull(), t) for c, t in zip(found, ("index", "known", "keyword", "series"), strict=True)))
    return joined.withColumn("tier", tier).withColumn("code", F.coalesce(*found)).drop("__k", "__stem", *found)


def recover_missing(terms: DataFrame, names: DataFrame, rows: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, term, text) and described names(doc_id, code, name): codes whose name a term's text holds and its rows lack.

    A name within a longer one found there doesn't count.
    """
    long = names.filter(F.length("name") >= least).select("doc_id", "code", "name")
    met = terms.join(long, "doc_id").filter(F.contains("text", "name")).select("doc_id", "term", "code", "name")
    longer = met.select("doc_id", "term", F.col("name").alias("other"))
    inside = met.join(longer, ["doc_id", "term"]).filter((F.col("name") != F.col("other")) & F.contains("other", "name")).select("doc_id", "term", "code", "name").distinct()
    free = met.join(inside, ["doc_id", "term", "code", "name"], "left_anti")
    return free.join(rows.select("doc_id", "term", "code"), ["doc_id", "term", "code"], "left_anti").select("doc_id", "term", "code", "name")


def series_gaps(rows: DataFrame, deficits: DataFrame, by: list[str]) -> DataFrame:
    """Numbers missing from a series (stem, number, credits, term), put in a term whose deficit is the credits of its sibling.

    The sibling is the row of the next number there is. Its own term is taken
    if it lacks just that, else the only term that does. rows and
    deficits(term, deficit) have `by`.
    """
    series = rows.groupBy(*by, "stem").agg(F.max("number").alias("last"), F.collect_set("number").alias("held"))
    gaps = series.select(*by, "stem", F.explode(F.array_except(F.sequence(F.lit(1), F.col("last")), "held")).alias("number"))
    later = rows.select(*by, "stem", F.col("number").alias("__no"), "credits", F.col("term").alias("__own"))
    sibling = gaps.join(later, [*by, "stem"]).filter("__no > number").groupBy(*by, "stem", "number").agg(F.min(F.struct("__no", "credits", "__own")).alias("s"))
    joined = sibling.select(*by, "stem", "number", "s.credits", "s.__own").join(deficits, by).filter("deficit = credits")
    found = joined.groupBy(*by, "stem", "number", "credits").agg(F.max(F.when(F.col("term") == F.col("__own"), F.col("term"))).alias("__own"), F.count("*").alias("__n"), F.min("term").alias("__only"))
    return found.withColumn("term", F.coalesce("__own", F.when(F.col("__n") == 1, F.col("__only")))).filter("term is not null").select(*by, "stem", "number", "credits", "term")


def trim_to_printed(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """A name becomes the longest printed name of its code that it starts with and goes beyond."""
    known = printed.select("code", F.col("name").alias("__p")).distinct()
    found = rows.select("code", "name").distinct().join(known, "code").filter(F.startswith("name", "__p") & (F.col("name") != F.col("__p")) & (F.col("__p") != ""))
    best = found.groupBy("code", "name").agg(F.max_by("__p", F.length("__p")).alias("__best"))
    return rows.join(best, ["code", "name"], "left").withColumn("name", F.coalesce("__best", "name")).drop("__best").select(*rows.columns)


def trim_glued(rows: DataFrame, printed: DataFrame, least: int = 8) -> DataFrame:
    """A name that goes on for `least` characters or more, white space aside, beyond the only printed name of its code is cut to it."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    single = printed.filter("name <> ''").groupBy("code").agg(F.when(F.count_distinct(bare(F.col("name"))) == 1, F.min("name")).alias("__p")).filter("__p is not null")
    joined = rows.join(single, "code", "left")
    glued = F.startswith(bare(F.col("name")), bare(F.col("__p"))) & (F.length(bare(F.col("name"))) - F.length(bare(F.col("__p"))) >= least)
    return joined.withColumn("name", F.when(glued, F.col("__p")).otherwise(F.col("name"))).select(*rows.columns)


def restore_spacing(rows: DataFrame, printed: DataFrame) -> DataFrame:
    """A name without white space becomes the one spaced form that is printed of it; where several are, it stays."""
    bare = F.regexp_replace("name", r"(?U)\s+", "")
    spaced = printed.filter(F.col("name").rlike(r"(?U)\s")).groupBy(bare.alias("__k")).agg(F.when(F.count_distinct("name") == 1, F.min("name")).alias("__p"))
    joined = rows.join(spaced, F.col("name") == F.col("__k"), "left")
    return joined.withColumn("name", F.coalesce("__p", "name")).select(*rows.columns)


def drop_recovered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Recovered rows of a code that a term (by) has anyway go; a group that such a row was in takes the kept row in, if that is in none."""
    first = F.min_by(F.struct("ordinal"), "ordinal")
    kept = rows.filter(~F.col("recovered")).groupBy(*by, "code").agg(first.alias("__kept"), F.lit(True).alias("__there"))
    gone = rows.filter("recovered").join(kept.select(*by, "code", "__kept"), [*by, "code"]).filter("alt_group is not null").groupBy(*by, "code").agg(F.min("alt_group").alias("__group"))
    joined = rows.join(kept, [*by, "code"], "left").join(gone, [*by, "code"], "left")
    heir = ~F.col("recovered") & F.col("alt_group").isNull() & (F.col("__kept.ordinal") == F.col("ordinal"))
    left = joined.filter(~(F.col("recovered") & F.coalesce("__there", F.lit(False))))
    return left.withColumn("alt_group", F.when(heir, F.col("__group")).otherwise(F.col("alt_group"))).select(*rows.columns)


def group_numbered_slots(rows: DataFrame, by: list[str]) -> DataFrame:
    """Slots of one number and two or more labels in a term are alternatives of each other."""
    label = F.regexp_replace(F.regexp_replace("name", r"\s+", ""), "[0-9]+$", "")
    number = F.regexp_extract("name", "([0-9]+)$", 1)
    own = rows.withColumns({"__label": label, "__number": number})
    w = Window.partitionBy(*by, "__number")
    several = (F.min("__label").over(w) != F.max("__label").over(w)) & (F.col("__number") != "")
    return own.withColumn("alt_group", F.when(several, F.concat(F.lit("E"), "__number")).otherwise(F.col("alt_group"))).drop("__label", "__number")

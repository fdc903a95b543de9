"""Names, citations and requirements."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantables.functions.text import positive_pages
from plantables.sources.scratch import written


def resolve_names(asked: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(name) against (alias, code) -> name, codes (sorted), code where there is one, and status unique, ambiguous or none.

    Codes of the aliases equal without spaces and case; only where there is
    none, those of all aliases that hold the name. For these a name is joined
    by the one of its three-letter pieces that the fewest aliases have.
    """
    bare = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))
    stored = lexicon.select(bare(F.col("alias")).alias("__k"), "code").filter("__k <> ''").distinct()
    names = asked.select("name").distinct().withColumn("__k", bare(F.col("name")))
    same = names.join(stored, "__k").select("name", "code")
    rest = names.join(same, "name", "left_anti").filter("__k <> ''")
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substr(c, i, F.lit(3))))
    short = F.length("__k") < 3
    ends = F.flatten(F.transform(F.sequence(F.lit(1), F.length("__k")), lambda i: F.array(F.substr("__k", i, F.lit(1)), F.substr("__k", i, F.lit(2)))))
    spread = stored.select("code", "__k").withColumn("__piece", F.explode(F.array_distinct(F.concat(pieces(F.col("__k")), ends))))
    often = spread.groupBy("__piece").agg(F.count("*").alias("__n"))
    rare = rest.withColumn("__piece", F.explode(F.when(short, F.array("__k")).otherwise(pieces(F.col("__k"))))).join(often, "__piece").groupBy("name", "__k").agg(F.min_by("__piece", F.struct("__n", "__piece")).alias("__piece"))
    within = rare.join(spread.withColumnRenamed("__k", "__in"), "__piece").filter(F.contains("__in", "__k")).select("name", "code")
    found = same.unionByName(within).groupBy("name").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    joined = asked.select("name").distinct().join(found, "name", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    n = F.size("codes")
    return joined.select("name", "codes", F.when(n == 1, F.get("codes", F.lit(0))).alias("code"), F.when(n == 0, "none").when(n == 1, "unique").otherwise("ambiguous").alias("status"))


def citations(evidence: DataFrame, plan: DataFrame, course: DataFrame) -> DataFrame:
    """evidence(id, code, year, semester, pages as JSON text) -> id, owner, pages; rows without a readable page are left out.

    The owner is plan_item where a row has the code, the same pages, and year
    and semester, null or not; else course by code and pages; else unknown.
    plan and course hold pages as arrays.
    """
    cited = evidence.withColumn("__pages", positive_pages(F.col("pages"))).filter(F.size("__pages") > 0)
    own = lambda df, *more: df.select("code", *more, F.array_sort(F.array_distinct("pages")).alias("__pages")).filter(F.size("__pages") > 0).distinct()
    e, p = cited.alias("e"), own(plan, "year", "semester").alias("p")
    same = (F.col("e.code") == F.col("p.code")) & (F.col("e.__pages") == F.col("p.__pages"))
    hit = e.join(p, same & F.col("e.year").eqNullSafe(F.col("p.year")) & F.col("e.semester").eqNullSafe(F.col("p.semester")), "left_semi").select("id").withColumn("__plan", F.lit(True))
    joined = cited.join(hit, "id", "left").join(own(course).withColumn("__course", F.lit(True)), ["code", "__pages"], "left")
    return joined.select("id", F.when(F.col("__plan"), "plan_item").when(F.col("__course"), "course").otherwise("unknown").alias("owner"), F.col("__pages").alias("pages"))


def pages_of(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Sorted distinct pages of all page columns of a group's rows."""
    none = F.array().cast("array<int>")
    each = rows.select(*by, F.explode_outer(F.concat(*(F.coalesce(c, none) for c in columns))).alias("page")).distinct()
    return each.groupBy(*by).agg(F.array_sort(F.collect_list("page")).alias("pages"))


def enrich_citations(cites: DataFrame, documents: DataFrame, page_map: DataFrame, identity: list[str]) -> DataFrame:
    """cites(doc, pages and identity columns) -> a row for each stored page: citation id, basis, pdf_page, label, verified, and all_verified.

    documents(doc, n_pages, basis): pdf, printed or unknown. page_map(doc,
    page, pdf_page, label, marked, content_verified): marked pages stand as
    such in the text. A document of unknown basis is one by PDF pages where
    all of a citation's pages are marked, and so is each marked page by
    itself. A page outside the document has no pdf_page. A page is verified
    where its content was and it has a pdf_page; a citation where all its
    pages are. The id is a hash of what the citation says.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc", *identity)]
    own = cites.withColumn("id", F.concat(F.lit("ref-"), F.substring(F.sha2(F.concat_ws("|", *said, F.array_join("pages", ",")), 256), 1, 16)))
    each = own.select("doc", "id", F.explode(F.array_distinct("pages")).alias("page")).filter("page > 0").distinct()
    joined = each.join(page_map, ["doc", "page"], "left").join(documents.select("doc", "n_pages", F.coalesce("basis", F.lit("unknown")).alias("__basis")), "doc", "left")
    whole = Window.partitionBy("doc", "id")
    marked, stated = F.coalesce("marked", F.lit(False)), F.coalesce("__basis", F.lit("unknown"))
    by_page = F.when((stated == "unknown") & marked, "pdf").otherwise(stated)
    told = joined.withColumns({"basis": F.when((stated == "unknown") & F.min(marked).over(whole), "pdf").otherwise(stated), "__by": by_page})
    pdf = F.coalesce("pdf_page", F.when(F.col("__by") == "pdf", F.col("page")))
    told = told.withColumn("pdf_page", F.when((pdf >= 1) & (F.col("n_pages").isNull() | (pdf <= F.col("n_pages"))), pdf))
    verified = F.col("pdf_page").isNotNull() & F.col("n_pages").isNotNull() & F.coalesce("content_verified", F.lit(False))
    label = F.coalesce("label", F.when(F.col("__by") == "printed", F.col("page").cast("string")))
    told = told.withColumns({"label": label, "verified": verified})
    return told.select("doc", "id", "basis", "page", "pdf_page", "label", "verified", F.min("verified").over(whole).alias("all_verified"))


def confirm_claims(claims: DataFrame) -> DataFrame:
    """(claimed, evidence arrays of pages): those that the evidence holds, and those made up."""
    return claims.withColumns({"confirmed": F.array_sort(F.array_intersect("claimed", "evidence")), "invented": F.array_sort(F.array_except("claimed", "evidence"))}).drop("claimed", "evidence")


def requirement_levels(nodes: DataFrame) -> DataFrame:
    """nodes(node, parent, ..) -> (node, level), 0 without children, else one more than the highest child's.

    A node gets its level in the round after its last child got one; rounds
    end when no node gets any, so trees may have any shape and depth, and a
    node several parents. Nodes on a cycle, and those above one, get none.
    """
    edges = nodes.filter("parent is not null").select("node", "parent").distinct()
    waiting = written(edges.groupBy("parent").agg(F.count("*").alias("waits")), "waiting")
    fresh = written(nodes.select("node").union(edges.select("parent")).distinct().join(waiting.select(F.col("parent").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)), "level")
    done, level = fresh, 0
    while not fresh.isEmpty():
        level += 1
        told = edges.join(fresh, "node").groupBy("parent").agg(F.count("*").alias("told"))
        waiting = written(waiting.join(told, "parent", "left").select("parent", (F.col("waits") - F.coalesce("told", F.lit(0))).alias("waits")), "waiting")
        fresh = waiting.filter("waits = 0").select(F.col("parent").alias("node"), F.lit(level).alias("level"))
        waiting = waiting.filter("waits > 0")
        done = done.unionByName(fresh)
    return done


def requirement_cycles(nodes: DataFrame) -> DataFrame:
    """The nodes that can't be evaluated, as they are on a cycle or above one."""
    every = nodes.select("node").union(nodes.filter("parent is not null").select("parent")).distinct()
    return every.join(requirement_levels(nodes), "node", "left_anti")


def evaluate_requirements(leaves: DataFrame, nodes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Three-valued trees of any shape. leaves(student, node, value boolean or null), nodes(node, parent, op all_of or any_of of the parent).

    all_of is false with any false child, else unknown with any unknown, else
    true; any_of the other way round. A node is folded once, when all its
    children are: levels first, as they don't depend on the student, then a
    join and a sum for each level. A child without a row is unknown, and so is
    a node without children that no leaf gives. A value given for a node that
    has children counts for nothing.
    -> (student, node, value): nodes without a parent, for each student with a
    leaf below; or just what is asked (student, node). There, what stands on a
    cycle or above one (requirement_cycles()) is unknown.
    """
    edges = nodes.filter("parent is not null").select("node", "parent", "op").distinct()
    shape = written(edges.groupBy("parent").agg(F.count("*").alias("n"), F.max("op").alias("op")).withColumnRenamed("parent", "node").join(requirement_levels(nodes), "node"), "shape")
    up = written(edges.select("node", "parent").join(shape.select(F.col("node").alias("parent"), F.col("level").alias("__at"), "n", "op"), "parent"), "edges")
    now = leaves.join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("student", "node", "value")
    tops = nodes.filter("parent is null").select("node").distinct()
    found, now = [now.join(tops, "node", "left_semi")], written(now.join(up, "node", "left_semi"), "values")
    for level in range(1, (shape.agg(F.max("level")).first()[0] or 0) + 1):
        told = now.join(up.filter(F.col("__at") == level), "node").groupBy("student", F.col("parent").alias("node")).agg(F.count_if("value").alias("yes"), F.count_if(~F.col("value")).alias("no"), F.max("n").alias("n"), F.max("op").alias("op"))
        every = F.when(F.col("no") > 0, False).when(F.col("yes") == F.col("n"), True)
        some = F.when(F.col("yes") > 0, True).when(F.col("no") == F.col("n"), False)
        fresh = written(told.select("student", "node", F.when(F.col("op") == "all_of", every).otherwise(some).alias("value")), "folded")
        found.append(fresh.join(tops, "node", "left_semi"))
        # what has a parent of a higher level waits for its turn
        now = written(now.unionByName(fresh).join(up.filter(F.col("__at") > level), "node", "left_semi"), "values")
    values = found[0].select("student", "node", "value")
    for more in found[1:]:
        values = values.unionByName(more.select("student", "node", "value"))
    return values if asked is None else asked.select("student", "node").join(values, ["student", "node"], "left")


def requirement_leaves(students: DataFrame, leaves: DataFrame, completed: DataFrame, approved: DataFrame) -> DataFrame:
    """(student, node, value) for leaves(node, code, min_grade, equivalent) of each student.

    completed(student, code, grade): a course not completed is false; with a
    least grade it is unknown while the grade is. approved(student, code): a
    leaf of an approved equivalent is true with it, else unknown. A leaf
    without a course is unknown.
    """
    each = students.select("student").crossJoin(F.broadcast(leaves))
    done = completed.groupBy("student", "code").agg(F.max("grade").alias("__grade"), F.lit(True).alias("__done"))
    given = approved.select("student", F.col("code").alias("equivalent"), F.lit(True).alias("__approved")).distinct()
    joined = each.join(done, ["student", "code"], "left").join(given, ["student", "equivalent"], "left")
    course = F.when(F.col("__done").isNull(), False).when(F.col("min_grade").isNull(), True).otherwise(F.col("__grade") >= F.col("min_grade"))
    value = F.when(F.col("equivalent").isNotNull(), F.col("__approved")).when(F.col("code").isNotNull(), course)
    return joined.select("student", "node", value.alias("value"))


def requirement_minimums(required: DataFrame, earned: DataFrame, by: list[str]) -> DataFrame:
    """(by, least, pages) against earned credits: met, short, or unknown without a record; pages are those of the requirement."""
    joined = required.join(earned, by, "left")
    status = F.when(F.col("credits").isNull(), "unknown").when(F.col("credits") >= F.col("least"), "met").otherwise("short")
    return joined.select(*by, "least", "pages", "credits", status.alias("status"))


def eligibility(asked: DataFrame, course: DataFrame, required: DataFrame, by: list[str], category: str = "free_elective") -> DataFrame:
    """Whether asked courses (by, code) may count for a category: what is known of them, and its least credits with their pages.

    course(code, credits, source, ..): the row of the last source by name is
    taken. The status stays unknown, as no table says that a course counts;
    found tells a course without a record.
    """
    last = course.groupBy("code").agg(F.max_by(F.struct("source", "credits"), "source").alias("__c"))
    least = required.filter(F.col("category") == category).select(*by, F.col("least").alias("minimum"), "pages")
    joined = asked.join(last, "code", "left").join(least, by, "left")
    return joined.select(*by, "code", F.col("__c").isNotNull().alias("found"), "__c.source", "__c.credits", "minimum", "pages", F.lit("unknown").alias("status"))


MENTIONS = "id long, start int, end int, alias string, code string, codes array<string>"
#: Aliases that are broadcast at a time; a larger lexicon goes over the texts in several passes.
LEXICON_PART = 200_000


def _automaton(name: str, given, held: dict[str, ahocorasick.Automaton | None] = {}) -> ahocorasick.Automaton | None:  # noqa: B006  kept by the worker on purpose
    """The automaton of a broadcast part of the lexicon, made once in a worker; one is kept. None without aliases."""
    if name not in held:
        held.clear()
        search = ahocorasick.Automaton()
        for alias, codes in given.value:
            search.add_word(alias, (alias, codes))
        if given.value:
            search.make_automaton()
        held[name] = search if given.value else None
    return held[name]


def match_mentions(texts: DataFrame, lexicon: DataFrame, part: int = LEXICON_PART) -> DataFrame:
    """(id, text) against (alias, code) -> spans that don't overlap: the longest first, then the earliest.

    Case and the amount of white space don't count; where an alias begins or
    ends with an ASCII letter, digit or underscore, none may stand beside it.
    code is null where an alias has several; codes lists them. Spans are
    places in the text with single spaces. Ids tell texts apart. The aliases
    are counted: up to `part` of them are broadcast at a time, and what several
    passes find is put together by text.
    """
    spark = texts.sparkSession
    key = F.lower(F.trim(F.regexp_replace("alias", r"(?U)\s+", " ")))
    known = lexicon.groupBy(key.alias("alias")).agg(F.array_sort(F.collect_set("code")).alias("codes")).filter("alias <> ''")
    passes = max(1, -(-known.count() // part))
    named = texts.select(F.col("id").cast("long"), F.col("text").cast("string"))

    def scan(given, whole: bool):
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _automaton(name, given)
            for b in batches:
                out: list[tuple] = []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    hits = mentions(" ".join((text or "").split()).lower(), search)
                    out += [(i, *x) for x in (longest(hits) if whole else hits)]
                yield _spans(out)

        return run

    found = None
    for k in range(passes):
        rows = known.filter(F.pmod(F.xxhash64("alias"), F.lit(passes)) == k)
        given = spark.sparkContext.broadcast([(r.alias, r.codes) for r in rows.toLocalIterator()])
        hits = named.mapInArrow(scan(given, passes == 1), MENTIONS)
        found = hits if found is None else found.unionByName(hits)
    if passes == 1:
        return found

    def together(hits: pa.Table) -> pa.Table:
        i = hits["id"][0].as_py()
        rows = [tuple(x.values()) for x in hits.drop_columns(["id"]).to_pylist()]
        return pa.Table.from_batches([_spans([(i, *x) for x in longest([(s, e, a, c) for s, e, a, _, c in rows])])])

    return found.groupBy("id").applyInArrow(together, MENTIONS)


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (id, start, end, alias, codes) as MENTIONS."""
    whole = [(i, s, e, a, c[0] if len(c) == 1 else None, c) for i, s, e, a, c in rows]
    columns = list(zip(*whole, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in MENTIONS.split(", ")])


def mentions(text: str, search) -> list[tuple]:
    """All hits (start, end, alias, codes) with free edges."""
    word = lambda c: c.isascii() and (c.isalnum() or c == "_")
    hits = []
    for last, (alias, codes) in search.iter(text) if search else ():
        start, end = last - len(alias) + 1, last + 1
        if not (word(alias[0]) and start and word(text[start - 1]) or word(alias[-1]) and end < len(text) and word(text[end])):
            hits.append((start, end, alias, codes))
    return hits


def longest(hits: list[tuple]) -> list[tuple]:
    """Of overlapping hits the longest, then the earliest; in order."""
    taken, out = bytearray(max((h[1] for h in hits), default=0)), []
    for hit in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if not any(taken[hit[0] : hit[1]]):
            taken[hit[0] : hit[1]] = b"\1" * (hit[1] - hit[0])
            out.append(hit)
    return sorted(out)

"""Joins of citations and references within documents.

Every join is an equi-join on (doc_id, key); the prefix fallback is an equi-join on (doc_id, year, first three letters). So all
of them hash by keys that spread over documents, and a document's rows alone decide its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import doublings, first_match, let
from foliospark.operators.refs import initial_of_ref, initial_of_token, institutional, match_key, surname_of_ref, surname_of_token
from foliospark.session import settled


#: The columns of references that author-date matching and the link index read.
KEY_COLUMNS = ("first_author", "is_institutional", "author_form", "year")


def number_matches(citations: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, n, position and line_no of every cited number (null line_no: dangling). Of references with one number the last counts."""
    cited = citations.select("doc_id", "position", F.posexplode("numbers").alias("seq", "n"))
    by_number = refs.groupBy("doc_id", F.col("num_label").alias("n")).agg(F.max("line_no").alias("line_no"))
    return cited.join(by_number, ["doc_id", "n"], "left")


def dangling(matches: DataFrame) -> DataFrame:
    """Citations without a reference."""
    return matches.where("line_no is null").drop("line_no")


def uncited(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """References that no citation matches."""
    return refs.join(matches.where("line_no is not null").select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_anti")


def keyed_refs(refs: DataFrame) -> DataFrame:
    """References with key, initial and the prefix key; a two-name institution also gets an alternative key."""
    name = F.when(F.col("is_institutional"), F.col("first_author")).otherwise(surname_of_ref("first_author", "author_form"))
    out = refs.withColumn("key", match_key(name, F.col("is_institutional"))).withColumn("initial", initial_of_ref("first_author", "author_form"))
    return out.withColumn("prefix", F.when(F.length("key") > 3, F.substring("key", 1, 3)))


def keyed_citations(parts: DataFrame) -> DataFrame:
    """Citation parts with their key, that of both names joined by "and", the initial and the prefix key."""
    name = F.coalesce("first_author", F.lit(""))
    place = institutional(name)
    out = parts.withColumn("key", match_key(F.when(place, name).otherwise(surname_of_token(name)), place)).withColumn("initial", initial_of_token("first_author"))
    both = F.concat_ws(" and ", F.get("authors", F.lit(0)), F.get("authors", F.lit(1)))
    out = out.withColumn("alt_key", F.when(F.size("authors") == 2, match_key(both, F.lit(True))))
    return out.withColumn("prefix", F.when(F.length("key") > 3, F.substring("key", 1, 3)))


def author_date_matches(parts: DataFrame, refs: DataFrame) -> DataFrame:
    """One row for each citation part with status and line_no.

    status: exact, resolved (several references of the key, one has the initial), ambiguous, alternative (joint name of an institution),
    suggestion (same year, same first three letters; the first such reference; not counted as cited), none.
    """
    # Three groupings read the references; as a checkpoint of what they need they are read from the text once.
    c, r = keyed_citations(parts), settled(keyed_refs(refs).select("doc_id", "line_no", "key", "initial", "prefix", "year"))
    groups = r.groupBy("doc_id", "key", "year").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).alias("n_refs"), F.collect_list(F.struct("initial", "line_no")).alias("options"))
    alt = groups.select("doc_id", F.col("key").alias("alt_key"), "year", F.col("first_line").alias("alt_line"))
    near = r.where("prefix is not null").groupBy("doc_id", "prefix", "year").agg(F.min("line_no").alias("near_line"))
    joined = c.join(groups, ["doc_id", "key", "year"], "left").join(alt, ["doc_id", "alt_key", "year"], "left").join(near, ["doc_id", "prefix", "year"], "left")
    fitting = F.filter("options", lambda o: o["initial"] == F.col("initial"))
    status = (
        F.when(F.col("n_refs") == 1, "exact")
        .when(F.col("n_refs") > 1, F.when(F.size(fitting) == 1, "resolved").otherwise("ambiguous"))
        .when(F.col("alt_line").isNotNull(), "alternative")
        .when(F.col("near_line").isNotNull(), "suggestion")
        .otherwise("none")
    )
    line = F.when(status == "exact", F.col("first_line")).when(status == "resolved", F.get(fitting, F.lit(0))["line_no"]).when(status == "alternative", F.col("alt_line"))
    return joined.withColumn("status", status).withColumn("line_no", line).withColumn("suggested_line", F.when(status == "suggestion", F.col("near_line"))).drop("options", "first_line", "n_refs", "alt_line", "near_line")


def author_date_uncited(refs: DataFrame, matches: DataFrame) -> DataFrame:
    """References no citation counts for; outside collisions a cited key with the same year and first three letters saves one too."""
    r = keyed_refs(refs)
    w = Window.partitionBy("doc_id", "key", "year")
    r = r.withColumn("crowd", F.count(F.lit(1)).over(w))
    hit = matches.where("line_no is not null").select("doc_id", "line_no").distinct()
    near = matches.where("prefix is not null").select("doc_id", "prefix", "year").distinct()
    left = r.join(hit, ["doc_id", "line_no"], "left_anti")
    saved = left.where("crowd = 1").join(near, ["doc_id", "prefix", "year"], "left_semi").select("doc_id", "line_no")
    return left.join(saved, ["doc_id", "line_no"], "left_anti").drop("crowd")


def collisions(refs: DataFrame) -> DataFrame:
    """doc_id, key, year, n_refs and same_person of references that share surname and year; without initials they count as one person."""
    return (
        keyed_refs(refs).groupBy("doc_id", "key", "year").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("initial").alias("n_initials")).where("n_refs > 1")
        .select("doc_id", "key", "year", "n_refs", (F.col("n_initials") <= 1).alias("same_person"))
    )


def author_page_matches(parts: DataFrame, refs: DataFrame) -> DataFrame:
    """All references with the cited name count; one row for each pair, null line_no where there is none."""
    return keyed_citations(parts).join(keyed_refs(refs).select("doc_id", "key", "line_no"), ["doc_id", "key"], "left")


def citation_map(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, line_no, label, times_cited and matched: citations and references side by side, each distinct label once."""
    cited = matches.groupBy("doc_id", F.col("line_no").alias("c_line"), F.concat_ws(", ", "key", "year").alias("cite_label")).agg(F.count(F.lit(1)).alias("times_cited"))
    listed = refs.select(F.col("doc_id").alias("r_doc"), F.col("line_no").alias("r_line"), F.concat_ws(", ", "first_author", "year").alias("ref_label"))
    both = cited.join(listed, (F.col("doc_id") == F.col("r_doc")) & (F.col("c_line") == F.col("r_line")), "full_outer")
    return both.select(F.coalesce("doc_id", "r_doc").alias("doc_id"), F.coalesce("c_line", "r_line").alias("line_no"), "cite_label", "ref_label", F.coalesce("times_cited", F.lit(0)).alias("times_cited"), (F.col("c_line").isNotNull() & F.col("r_line").isNotNull()).alias("matched")).dropDuplicates(["doc_id", "line_no", "cite_label", "ref_label"])


def resolve_any(events: DataFrame, refs: DataFrame) -> DataFrame:
    """Citations of any family (doc_id, family, event_id, n, key, year) against one list: status ok, ambiguous or nomatch, and line_no if ok."""
    r = keyed_refs(refs)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    r = r.withColumn("n", F.coalesce("num_label", F.row_number().over(w)))
    options = (
        r.select("doc_id", F.lit("numeric").alias("family"), F.col("n").cast("string").alias("lookup"), "line_no")
        .unionByName(r.select("doc_id", F.lit("author-date").alias("family"), F.concat_ws("_", "key", F.regexp_replace("year", "[a-z]$", "")).alias("lookup"), "line_no"))
        .unionByName(r.select("doc_id", F.lit("author-page").alias("family"), F.col("key").alias("lookup"), "line_no"))
    )
    found = options.groupBy("doc_id", "family", "lookup").agg(F.count(F.lit(1)).alias("k"), F.min("line_no").alias("line_no"))
    lookup = F.when(F.col("family") == "numeric", F.col("n").cast("string")).when(F.col("family") == "author-date", F.concat_ws("_", "key", F.regexp_replace("year", "[a-z]$", ""))).otherwise(F.col("key"))
    out = events.withColumn("lookup", lookup).join(found, ["doc_id", "family", "lookup"], "left")
    status = F.when(F.col("k") == 1, "ok").when(F.col("k") > 1, "ambiguous").otherwise("nomatch")
    return out.withColumn("status", status).withColumn("line_no", F.when(status == "ok", F.col("line_no"))).drop("k", "lookup")


def link_index(refs: DataFrame) -> DataFrame:
    """doc_id, link_key and line_no: surname and plain year, and the acronym of an institution, of each the first reference."""
    plain = F.regexp_replace(F.coalesce("year", F.lit("")), "(?<=\\d)[a-z]$", "")
    acronym = F.lower(F.coalesce(first_match("first_author", "[\\(\\[]([A-Z]{2,8})[\\)\\]]"), first_match("first_author", "^([A-Z]{2,8})\\.?$")))
    r = keyed_refs(refs).select("doc_id", "line_no", F.explode(F.array_compact(F.array("key", acronym))).alias("name"), plain.alias("y"))
    return r.groupBy("doc_id", F.concat_ws("_", "name", "y").alias("link_key")).agg(F.min("line_no").alias("line_no"))


def links(parts: DataFrame, refs: DataFrame) -> DataFrame:
    """Citation parts with the reference to link to, by the link index."""
    plain = F.regexp_replace(F.coalesce("year", F.lit("")), "(?<=\\d)[a-z]$", "")
    acronym = F.lower(first_match("first_author", "^([A-Z]{2,8})$"))
    c = keyed_citations(parts).withColumn("link_key", F.concat_ws("_", F.coalesce(acronym, "key"), plain))
    return c.join(link_index(refs), ["doc_id", "link_key"], "left")


def first_wins(spans: Column) -> Column:
    """Of spans ordered by start (array of structs with start and end), those that don't overlap one taken before.

    From each span a pointer leads to the first one that starts at or behind its end, found by bisection over the starts. The spans taken are what the first one
    reaches: each round adds what lies 1, 2, 4, ... pointers behind those known, with pointers that double. Empty spans at one place follow each other.
    """

    def reached(x: Column) -> Column:
        starts = F.transform(x, lambda s: s["start"].cast("long"))

        def chosen(known: Column) -> Column:
            at, powers = known["at"], known["powers"]
            # How many starts lie below an end, at least all up to the span itself: bit by bit from the highest.
            ahead = lambda s, k: F.aggregate(powers, k + 1, lambda n, p: F.when(F.get(at, n + p - 1) < s["end"], n + p).otherwise(n))
            begin = F.struct(F.transform(x, ahead).alias("next"), F.filter(F.array(F.lit(0)), lambda k: F.size(x) > 0).alias("taken"))

            def round_(have: Column, _: Column) -> Column:
                more = F.filter(F.transform(have["taken"], lambda k: F.get(have["next"], k)), lambda k: k < F.size(x))
                return F.struct(F.transform(have["next"], lambda k: F.coalesce(F.get(have["next"], k), F.size(x))).alias("next"), F.concat(have["taken"], more).alias("taken"))

            taken = F.aggregate(F.concat(F.array(F.lit(1)), doublings(F.size(x))), begin, round_, lambda have: F.array_sort(have["taken"]))
            return F.transform(taken, lambda k: F.get(x, k))

        powers = F.reverse(F.concat(F.array(F.lit(1)), F.transform(doublings(F.size(x)), lambda p: p * 2)))
        return let(F.struct(starts.alias("at"), powers.alias("powers")), chosen)

    return let(spans, reached)


def accepted_spans(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end, ...) that don't overlap one accepted before: first by start wins, then the longer."""
    names = [c for c in spans.columns if c not in ("doc_id", "start", "end")]
    item = F.struct(F.col("start"), (-F.col("end")).alias("rank"), F.col("end"), *names)
    rows = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = F.explode(first_wins(F.col("items"))).alias("x")
    return rows.select("doc_id", kept).select("doc_id", "x.start", "x.end", *[f"x.{n}" for n in names])


def merged_spans(spans: DataFrame) -> DataFrame:
    """Overlapping spans as one with the strongest severity (error, warning, suggestion): islands by a running maximum."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    fresh = F.col("start") >= F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    rank = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    rows = spans.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(w)).withColumn("rank", rank)
    return rows.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max_by("severity", "rank").alias("severity")).drop("island")

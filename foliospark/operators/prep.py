"""Text preparation: lines, sentences, page artefacts, headings, the split into article and references, sections.

Operators take a DataFrame with ``doc_id`` and a text column and give rows keyed by ``doc_id``. What a
document needs in order (lines, offsets) is kept in arrays of that document where it is folded, and exploded to rows where
rows are the result, so none of it shuffles more than once by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import dims
from foliospark.functions.text import SPACES, any_word, joined_runs, let, preview, scan, squeeze, staged, text_of, word_count
from foliospark.session import settled

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = "(?iu)(?<![\\p{L}\\p{N}])(et al|e\\.g|i\\.e|vs|cf|no|fig|tabel|dkk|st|dr|prof|misal)\\.$"
NUMBERED = "^[\\dIVXLCivxlc]+[.\\)]\\s*"


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 1), start_off and text of every line; offsets are running sums within the document."""
    rows = df.select("doc_id", F.posexplode(F.split(text_of(text), "\n")).alias("pos", "text"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), start.alias("start_off"), "text")


def sentence_array(text: Column | str, least_words: int = 3) -> Column:
    """Sentences of at least ``least_words`` words; a part that ends in an abbreviation takes the next one on."""

    def whole(parts: Column) -> Column:
        # No abbreviation reaches over the end of a part, so a part alone tells whether the sentence goes on behind it.
        apart = lambda goes_on: F.transform(goes_on, lambda _, k: ~F.coalesce(F.get(goes_on, k - 1), F.lit(False)))
        return joined_runs(parts, let(F.transform(parts, lambda p: p.rlike(ABBREVIATIONS)), apart))

    found = let(F.split(squeeze(text), "(?<=[.!?])\\s+"), whole)
    # The text is squeezed, so single spaces part its words.
    return F.filter(found, lambda s: (s != "") & (F.size(F.split(s, " ")) >= least_words) if least_words > 1 else s != "")


def sentences(df: DataFrame, text: str = "text", least_words: int = 3) -> DataFrame:
    return df.select("doc_id", F.posexplode(sentence_array(text, least_words)).alias("sentence_no", "sentence"))


def strip_page_artifacts(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts without running headers and footers.

    A line of at most 200 characters that comes three times or more is one; after a run of at least two of these, a short line with a
    digit goes too. Texts under ten lines stay. Counting is a group by (doc_id, line), so long documents spread.
    """
    clean = df.withColumn("__t", F.regexp_replace(text_of(text), "\r\n?", "\n"))
    rows = clean.where(F.size(F.split("__t", "\n")) >= 10).select("doc_id", F.posexplode(F.split("__t", "\n")).alias("n", "line")).withColumn("key", F.trim("line"))
    often = rows.where((F.col("key") != "") & (F.length("key") <= 200)).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("c")).where("c >= 3").select("doc_id", "key", F.lit(True).alias("often"))
    w = Window.partitionBy("doc_id").orderBy("n")
    marked = rows.join(often, ["doc_id", "key"], "left").withColumn("often", F.coalesce("often", F.lit(False)))
    marked = marked.withColumn("b1", F.lag("often", 1, False).over(w)).withColumn("b2", F.lag("often", 2, False).over(w))
    number = ~F.col("often") & F.col("b1") & F.col("b2") & (F.col("key") != "") & (F.length("key") < 40) & F.col("key").rlike("\\d")
    kept = marked.where(~(F.col("often") | number)).groupBy("doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(n, line))), x -> x.line), '\n')").alias("kept"))
    touched = often.select("doc_id").distinct().withColumn("touched", F.lit(True))
    return clean.join(touched, "doc_id", "left").join(kept, "doc_id", "left").withColumn(text, F.when(F.col("touched"), F.coalesce("kept", F.lit(""))).otherwise(F.col("__t"))).select(*df.columns)


def _headings(df: DataFrame, text: str) -> DataFrame:
    """Lines that may be headings, with the length of what follows."""
    rows = lines(df.select("doc_id", F.col(text).alias("text")), "text")
    w = Window.partitionBy("doc_id").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    # What follows, trimmed, has 30 characters if what stands between its first and last visible character has.
    filled = F.when(F.trim("text") != "", F.col("line_no"))
    rows = rows.withColumn("trimmed", F.trim(F.regexp_replace("text", SPACES, " ")))
    rows = rows.withColumn("below", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)) - 1).withColumn("any_below", F.max(filled).over(w).isNotNull())
    short = rows.where((F.length("trimmed") > 0) & (F.length("trimmed") <= 60))
    stripped = F.regexp_replace(F.regexp_replace("trimmed", NUMBERED, ""), "[:.\\s]+$", "")
    return short.withColumn("stripped", stripped).withColumn("words", word_count("stripped")).withColumn("enough", F.col("any_below") & (F.col("below") >= 30))


def typo_heading(word: Column | str) -> Column:
    """Whether one word is a misspelt reference heading."""
    w = F.regexp_replace(F.lower(text_of(word)), "[^a-z]", "")
    near = [F.coalesce(F.levenshtein(w, F.lit(h), 2 if len(h) >= 8 else 1) >= 0, F.lit(False)) for h in dims.HEADING_WORDS]
    return (w != "") & ~w.isin(*dims.NOT_HEADINGS) & F.greatest(*near)


def find_reference_heading(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, start_off, heading_text, heading_length and heading_is_typo: the last heading with enough text below, else the last."""
    exact = F.col("stripped").rlike(dims.REFERENCE_HEADING) & (F.col("words") <= 4)
    typo = ~exact & (F.col("words") == 1) & typo_heading("stripped")
    found = _headings(df, text).withColumn("typo", typo).where(exact | F.col("typo"))
    best = F.max_by(F.struct("line_no", "start_off", F.col("trimmed").alias("heading_text"), F.length("text").alias("heading_length"), F.col("typo").alias("heading_is_typo")), F.struct("enough", "line_no"))
    return found.groupBy("doc_id").agg(best.alias("h")).select("doc_id", "h.*")


def find_intro_heading(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no and start_off of the first introduction heading with enough text below."""
    found = _headings(df, text).where(F.col("stripped").rlike(dims.INTRODUCTION_HEADING) & (F.col("words") <= 4) & F.col("enough"))
    return found.groupBy("doc_id").agg(F.min(F.struct("line_no", "start_off")).alias("h")).select("doc_id", "h.*")


def _capitals(t: Column) -> Column:
    return (F.length(t) > 0) & (F.length(t) <= 60) & (t == F.upper(t)) & t.rlike("[A-Z]")


def unwrapped(text: Column | str) -> Column:
    """Article text with hard-wrapped lines joined: a line goes on where the one before neither ends a sentence nor is a heading in capitals, and it is none itself.

    Two neighbouring lines alone decide: a heading in capitals is never joined with a line, so the line before is all that has to be looked at.
    """
    def facts(raw: Column) -> Column:
        t = F.trim(raw)
        return F.struct(raw.alias("raw"), t.alias("t"), (t == "").alias("blank"), _capitals(t).alias("heading"), t.rlike("[.!?:;][\")'\\]]?$").alias("ends"))

    def apart(x: Column, k: Column) -> Column:
        before = lambda c: F.coalesce(F.get(x, k - 1)[c], F.lit(True))
        own = lambda c: F.get(x, k)[c]
        return own("blank") | own("heading") | before("blank") | before("heading") | before("ends")

    def pieces(x: Column) -> Column:
        def piece(p: Column, k: Column) -> Column:
            fresh, closed = apart(x, k), (k + 1 >= F.size(x)) | apart(x, k + 1)
            body = F.when(fresh, p["raw"]).otherwise(p["t"])
            lead = F.when(k == 0, F.lit("")).when(fresh, F.lit("\n")).otherwise(F.lit(" "))
            return F.concat(lead, F.when(closed, body).otherwise(F.rtrim(body)))

        return F.array_join(F.transform(x, piece), "")

    return let(F.transform(F.split(text_of(text), "\n"), facts), pieces)


GENUINE = "\\b(19|20)\\d{2}[a-z]?\\b|(?i:\\bn\\.d\\.)|\\bdoi\\.org/|(?:^|\\s)10\\.\\d{4,9}/|https?://"


def rejoined_references(text: Column | str) -> Column:
    """Reference entries of a list whose lines may be wrapped, as an array, in order; chunks without year, DOI or link are left out.

    An entry starts at a numbered line, at a line that reads like authors with a year, behind an empty line, and behind an entry that is complete: one
    that has a year in any of its lines and ends as entries do. Whether the open entry has a year depends on where it began, so each line
    maps "the entry before it has a year" to "the entry it is in has one", two bits; running compositions of these maps (``scan``) give the state
    at every line.
    """
    numbered = lambda t: t.rlike("^\\s*(?:\\[\\d+\\]|\\(\\d+\\)|\\d+[.)])\\s*\\p{Lu}")
    dated = lambda t: t.rlike("^[\\p{Lu}\\p{Lo}]") & F.substring(t, 1, 100).contains(",") & F.substring(t, 1, 220).rlike("\\(\\d{4}[a-z]?\\)")
    year = lambda t: t.rlike("\\(\\d{4}[a-z]?\\)|(?:^|\\s)(19|20)\\d{2}[a-z]?[.,)]") | t.rlike("(?i)\\bn\\.d\\.")
    ends = lambda t: t.rlike("[.)]$|https?://\\S+$|\\d{4,9}/\\S*$")

    def facts(raw: Column) -> Column:
        t = F.trim(raw)
        return F.struct(t.alias("t"), (t == "").alias("blank"), (numbered(t) | dated(t)).alias("starts"), year(t).alias("year"), ends(t).alias("ends"))

    def chunks(x: Column) -> Column:
        before = lambda k, c: F.coalesce(F.get(x, k - 1)[c], F.lit(c == "blank"))
        first = lambda p, k: p["blank"] | p["starts"] | before(k, "blank")
        # from_no, from_yes: whether the entry has a year after this line if the open one had none, or had one, before it.
        maps = F.transform(x, lambda p, k: F.struct(p["year"].alias("from_no"), (p["year"] | ~(first(p, k) | before(k, "ends"))).alias("from_yes")))
        after = lambda f, b: F.when(b, f["from_yes"]).otherwise(f["from_no"])
        through = lambda a, b: F.struct(after(b, a["from_no"]).alias("from_no"), after(b, a["from_yes"]).alias("from_yes"))
        apart = lambda states: F.transform(x, lambda p, k: first(p, k) | (before(k, "ends") & F.coalesce(F.get(states, k - 1)["from_no"], F.lit(False))))
        return let(scan(maps, through), lambda states: joined_runs(F.transform(x, lambda p: p["t"]), apart(states)))

    lines_ = F.transform(F.split(text_of(text), "\r?\n"), facts)
    return F.filter(let(lines_, chunks), lambda t: (t != "") & genuine_reference(t))


def genuine_reference(t: Column) -> Column:
    return t.rlike(GENUINE)


def split_document(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, article, reference_text, heading_text, heading_is_typo; documents without a reference heading are left out."""
    clean = strip_page_artifacts(df.select("doc_id", text), text)
    both = clean.join(find_reference_heading(clean, text), "doc_id")
    before = F.trim(F.substring(F.col(text), F.lit(1), F.col("start_off")))
    after = F.expr(f"trim(substring(`{text}`, start_off + heading_length + 1))")
    return both.select("doc_id", unwrapped(before).alias("article"), F.array_join(rejoined_references(after), "\n").alias("reference_text"), "heading_text", "heading_is_typo")


def after_intro(citations: DataFrame, texts: DataFrame, text: str = "article") -> DataFrame:
    """Citations at or behind the introduction heading of their document; all where there is none."""
    intro = find_intro_heading(texts, text).select("doc_id", F.col("start_off").alias("intro"))
    return citations.join(intro, "doc_id", "left").where(F.col("position") >= F.coalesce("intro", F.lit(0))).drop("intro")


def section_of(text: Column | str) -> Column:
    """key and length of the section heading that a paragraph starts with, null where it doesn't."""
    return let(squeeze(text), lambda t: _section_of(t, word_count(t)))


def _section_of(t: Column, words: Column) -> Column:
    numbered = t.rlike("^(?:(?:[Bb][Aa][Bb]|[Ss]ection|[Cc]hapter)\\s*)?(?:\\d+(?:\\.\\d+)*|[IVXLCDM]+(?=[.:)\\s]))[.:)]?\\s*")
    real = numbered | ((t == F.upper(t)) & t.rlike("[A-Z]"))
    options = []
    for key, pattern, alone, risky in dims.SECTIONS:
        pattern = f"(?iu)^({pattern})"
        fits = t.rlike(pattern) & (real if risky else F.lit(True))
        hit = F.struct(F.lit(key).alias("key"), F.length(F.regexp_extract(t, pattern, 1)).alias("length"), F.lit(alone).alias("alone"))
        options.append(F.when(fits, hit))
    found = F.coalesce(*options)
    return F.when(~(found["alone"] & (words > 10)), found)


def sections(paragraphs: DataFrame) -> DataFrame:
    """doc_id, key, heading, start_para, start_off, end_para and end_off; of each key the first, up to the next heading.

    paragraphs: doc_id, para_no (from 0), text.
    """
    # Each paragraph is squeezed once; only those that open as some heading does are looked at heading by heading.
    rows = staged(paragraphs.select("doc_id", "para_no", "text"), t=squeeze("text"))
    rows = staged(rows.where(F.col("t").rlike(f"(?iu)^{dims.NUMBERING}{any_word(dims.SECTION_OPENINGS)}")), n_words=F.size(F.split("t", " ")))
    hits = staged(rows, s=_section_of(F.col("t"), F.col("n_words"))).where("s is not null").select("doc_id", "para_no", "t", "s")
    first = hits.groupBy("doc_id", F.col("s.key").alias("key")).agg(
        F.min("para_no").alias("start_para"), F.min_by("s.length", "para_no").alias("start_off"), F.min_by(F.trim(F.expr("substring(t, 1, s.length)")), "para_no").alias("heading")
    )
    sizes = paragraphs.groupBy("doc_id").agg(F.max("para_no").alias("last"))
    w = Window.partitionBy("doc_id").orderBy("start_para")
    return first.join(sizes, "doc_id").select(
        "doc_id", "key", "heading", "start_para", "start_off",
        F.coalesce(F.lead("start_para").over(w), F.col("last") + 1).alias("end_para"), F.coalesce(F.lead("start_off").over(w), F.lit(0)).alias("end_off"),
    )


def section_text(found: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, key, text, words, sentences and preview of each section: what follows the heading on its line and the paragraphs up to the next."""
    p = paragraphs.select(F.col("doc_id").alias("d"), "para_no", F.col("text").alias("para"))
    inside = found.join(p, (F.col("doc_id") == F.col("d")) & (F.col("para_no") >= F.col("start_para")) & ((F.col("para_no") < F.col("end_para")) | (F.col("para_no") == F.col("start_para"))))
    part = F.when(F.col("para_no") == F.col("start_para"), F.trim(F.substring(squeeze("para"), F.col("start_off") + 1, F.lit(2**31 - 1)))).otherwise(F.col("para"))
    rows = inside.withColumn("part", part).groupBy("doc_id", "key", "start_para").agg(F.collect_list(F.struct("para_no", "part")).alias("parts"))
    text = F.trim(F.array_join(F.transform(F.filter(F.array_sort("parts"), lambda x: F.coalesce(x["part"], F.lit("")) != ""), lambda x: x["part"]), "\n"))
    return rows.withColumn("text", text).select("doc_id", "key", "start_para", "text", word_count("text").alias("words"), F.size(sentence_array("text")).alias("sentences"), preview("text", 10).alias("preview"))


def doc_stats(paragraphs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row a document: title, abstract, keywords, missing main sections, words and sentences, references, author block.

    counts: doc_id, table_count, image_count where known.
    """
    found = settled(sections(paragraphs))  # a few rows a document, read twice
    # The texts of other sections aren't read here.
    texts = found.join(section_text(found.where(F.col("key").isin("abstract", "keywords")), paragraphs).drop("start_para"), ["doc_id", "key"], "left")
    flag = lambda k: F.coalesce(F.max(F.col("key") == k), F.lit(False))
    per_section = texts.groupBy("doc_id").agg(
        flag("abstract").alias("abstract_found"), F.max(F.when(F.col("key") == "abstract", F.col("words"))).alias("abstract_words"),
        F.max(F.when(F.col("key") == "keywords", F.size(F.filter(F.split("text", "[,;]"), lambda k: F.trim(k) != "")))).alias("keyword_count"),
        F.min(F.when(F.col("key") == "abstract", F.col("start_para"))).alias("abstract_para"), F.min(F.when(F.col("key") == "references", F.col("start_para"))).alias("ref_para"),
        F.min("start_para").alias("first_section"), flag("acknowledgment").alias("acknowledgment_found"),
        F.array_compact(F.array(
            F.when(~flag("introduction"), F.lit("introduction")), F.when(~flag("method"), F.lit("method")), F.when(~(flag("results") | flag("results_discussion")), F.lit("results")),
            F.when(~(flag("discussion") | flag("results_discussion")), F.lit("discussion")), F.when(~flag("conclusion"), F.lit("conclusion")),
        )).alias("missing"),
    )
    rows = paragraphs.select("doc_id", "para_no", F.coalesce("text", F.lit("")).alias("text"))
    rows = staged(rows, __squeezed=squeeze("text"))
    rows = staged(rows, words=F.when(F.col("__squeezed") == "", 0).otherwise(F.size(F.split("__squeezed", " ")))).drop("__squeezed")
    rows = rows.join(per_section, "doc_id", "left")
    before = F.col("para_no") < F.least(F.lit(10), F.coalesce("first_section", F.lit(10)))
    title = rows.where(before & (F.col("words") >= 3)).groupBy("doc_id").agg(F.min("para_no").alias("title_para"), F.min_by(squeeze("text"), "para_no").alias("title"))
    rows = rows.join(title, "doc_id", "left").withColumn("t0", F.coalesce("title_para", F.lit(-1)))
    body = (F.col("para_no") > F.col("t0")) & (F.col("ref_para").isNull() | (F.col("para_no") < F.col("ref_para")))
    block = (F.col("para_no") > F.col("t0")) & (F.col("para_no") < F.coalesce("abstract_para", F.lit(10)))
    n_sentences = F.size(sentence_array("text"))
    joined = lambda c: F.coalesce(F.max(c), F.lit(False))
    stats = rows.groupBy("doc_id").agg(
        F.max("title").alias("title"), F.max("abstract_found").alias("abstract_found"), F.max("abstract_words").alias("abstract_words"), F.max("keyword_count").alias("keyword_count"),
        F.max("missing").alias("missing"), F.max("acknowledgment_found").alias("acknowledgment_found"), F.sum("words").alias("total_words_whole"), F.sum(n_sentences).alias("total_sentences_whole"),
        F.coalesce(F.sum(F.when(body, F.col("words"))), F.lit(0)).alias("total_words"), F.coalesce(F.sum(F.when(body, n_sentences)), F.lit(0)).alias("total_sentences"),
        F.count_if(F.col("words") > 0).alias("paragraph_count"), F.count_if((F.col("para_no") > F.col("ref_para")) & (F.trim("text") != "")).alias("reference_count"),
        joined(block & F.col("text").rlike("[\\w.+-]+@[\\w-]+\\.[\\w.-]+")).alias("has_email"),
        joined(block & F.col("text").rlike("(?iu)\\b(faculty|fakultas|university|universitas|department|departemen|institute|institut|jurusan)\\b")).alias("has_affiliation"),
    )
    stats = stats.withColumn("abstract_found", F.coalesce("abstract_found", F.lit(False))).withColumn("acknowledgment_found", F.coalesce("acknowledgment_found", F.lit(False)))
    every = F.array(*[F.lit(k) for k in ("introduction", "method", "results", "discussion", "conclusion")])
    stats = stats.withColumn("missing", F.coalesce("missing", every)).withColumn("title_words", word_count("title"))
    for c in ("abstract_words", "keyword_count"):
        stats = stats.withColumn(c, F.coalesce(c, F.lit(0)))
    if counts is not None:
        stats = stats.join(counts.select("doc_id", "table_count", "image_count"), "doc_id", "left")
    return stats


def checklist(stats: DataFrame, recent: DataFrame) -> DataFrame:
    """doc_id, check_id and pass of the submission checklist. recent: doc_id, recent_pct of the reference lines."""
    s = stats.join(recent.select("doc_id", "recent_pct"), "doc_id", "left")
    checks = {
        "title": (F.col("title_words") > 0) & (F.col("title_words") <= 20), "abstract": F.col("abstract_words").between(150, 250), "keywords": F.col("keyword_count").between(3, 6),
        "imrad": F.size("missing") == 0, "references": F.col("reference_count") >= 20, "recency": F.coalesce(F.col("recent_pct") >= 50, F.lit(False)), "email": F.col("has_email"), "affiliation": F.col("has_affiliation"),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("check_id"), F.coalesce(c, F.lit(False)).alias("pass")) for k, c in checks.items()])).alias("c")
    return s.select("doc_id", rows).select("doc_id", "c.*")

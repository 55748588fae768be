"""Books into chapters, paragraphs, sentences and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill import fixed
from factmill.functions import text as T
from factmill.operators import terms as X
from factmill.session import cut, number_rows, running_sums

#: Lines, or chapters, of a book that one task counts.
PIECE = 4096


def split_sentences(c: T.ColumnLike) -> Column:
    """Array of sentences. The dot of an abbreviation doesn't end one; closing quotes at a break are lost."""
    c = F.col(c) if isinstance(c, str) else c
    # A dot is found first, then what stands before it. Breaks leave no space at the ends of sentences, but the text may have some.
    guarded = F.regexp_replace(T.strip_space(c), r"\.(?<=\b(?:" + "|".join(fixed.ABBREVIATIONS) + r")\.)", fixed.EOF_MARK)
    parts = F.transform(F.split(guarded, fixed.SENTENCE_BREAK), lambda s: F.replace(s, F.lit(fixed.EOF_MARK), F.lit(".")))
    return F.filter(parts, lambda s: s != "")


def keeps_paragraph(c: T.ColumnLike) -> Column:
    """Not short, an illustration, an editorial note or a citation."""
    c = F.col(c) if isinstance(c, str) else c
    return T.at_least_words(c, 6) & ~c.startswith("[Illustration") & ~T.is_editorial(c) & ~T.is_citation(c)


def lines(books: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line with its number from 0 and the offset of its first character; the other columns tell books apart.
    Offsets are running sums over a book's lines: a window, as array functions would take quadratic time in a long book."""
    keys = [c for c in books.columns if c != text_col]
    rows = T.unnest(books, F.split(F.col(text_col), "\n"), "line_no", "line", keys)
    before = F.sum((F.length("line") + 1).cast("long")).over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("off", F.coalesce(before, F.lit(0).cast("long")))


def split_chapters(book_lines: DataFrame, book: str = "book_id") -> DataFrame:
    """book, chapter, start_off and body of each chapter, from lines(). Headings are numbered titles or, with fewer than
    three of those and three or more bare Roman numerals, the numerals; a book with fewer than two headings is one
    chapter. Short bodies go and the rest are renumbered; long front matter is chapter 0. No task takes all lines of a book
    or all its bodies; a chapter is one row."""
    marked = book_lines.select(
        book, "line_no", "off", "line", F.col("line").rlike(fixed.CHAPTER_HEADING).alias("titled"), F.col("line").rlike(fixed.ROMAN_HEADING).alias("roman")
    ).withColumn("_piece", F.floor(F.col("line_no") / PIECE))
    marked = running_sums(marked, [book], "_piece", ["line_no"], {"n_titled": F.col("titled").cast("int"), "n_roman": F.col("roman").cast("int")})
    by_roman = (F.col("n_titled_all") < 3) & (F.col("n_roman_all") >= 3)
    head = F.when(by_roman, F.col("roman")).otherwise(F.col("titled"))
    count = F.when(by_roman, F.col("n_roman_all")).otherwise(F.col("n_titled_all"))
    before = F.when(by_roman, F.col("n_roman")).otherwise(F.col("n_titled"))
    marked = marked.withColumn("whole", count < 2).withColumn("head", head & ~F.col("whole"))
    island = F.when(F.col("whole"), 0).otherwise(before + F.col("head").cast("int"))
    parts = marked.withColumn("island", island).groupBy(book, "island", "whole").agg(
        F.min(F.when(F.col("head"), F.col("off") + F.length("line")).otherwise(F.col("off"))).alias("start_off"),
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("head"), F.lit("")).otherwise(F.col("line")).alias("line")))), lambda x: x["line"]).alias("ls"),
        F.coalesce(F.max(F.when(F.col("head"), F.col("line"))), F.lit("")).alias("heading"),
    )
    parts = parts.withColumn("body", F.array_join("ls", "\n")).withColumn("size", F.length(T.strip_space("body"))).drop("ls")
    kept = ~F.col("whole") & F.when(F.col("island") == 0, F.col("size") > fixed.MIN_FRONT_CHARS).otherwise(F.col("size") >= fixed.MIN_CHAPTER_CHARS)
    parts = cut(parts.withColumn("kept", kept).withColumn("_piece", F.floor(F.col("island") / PIECE)))
    chapters = running_sums(parts, [book], "_piece", ["island"], {"n": F.col("kept").cast("int"), "front": (F.col("kept") & (F.col("island") == 0)).cast("int")})
    chapter, start = F.col("n") + 1 - F.col("front_all"), F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("start_off"))
    chapters = chapters.filter("whole or kept").select(book, F.when(F.col("whole"), 1).otherwise(chapter).cast("int").alias("chapter"), start.alias("start_off"), "body")
    # A book of which nothing is left is one chapter.
    lost = cut(parts.groupBy(book).agg(F.max(F.col("whole") | F.col("kept")).alias("_left")).filter("not _left").select(F.col(book).alias("_lost")))
    if lost.isEmpty():
        return chapters
    again = parts.join(lost, F.col(book).eqNullSafe(F.col("_lost")), "left_semi").groupBy(book).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", F.concat("heading", "body").alias("s")))), lambda x: x["s"]), "\n").alias("body")
    )
    return chapters.unionByName(again.select(book, F.lit(1).alias("chapter"), F.lit(0).cast("long").alias("start_off"), "body"))


def split_paragraphs(chapters: DataFrame, keys: list[str], body: str = "body", start: str = "start_off") -> DataFrame:
    """keys, para (from 0 among all runs of non-empty lines), off and text of the paragraphs that keeps_paragraph() keeps,
    without footnote markers."""
    rows = lines(chapters.select(*keys, F.col(start).alias("_s"), F.col(body).alias("text")))
    w = Window.partitionBy(*keys).orderBy("line_no")
    rows = rows.withColumn("_gap", F.sum((F.col("line") == "").cast("int")).over(w)).filter("line <> ''")
    paras = rows.groupBy(*keys, "_gap").agg(
        (F.min("off") + F.first("_s")).alias("off"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("raw"),
    )
    paras = paras.withColumn("para", F.row_number().over(Window.partitionBy(*keys).orderBy("_gap")) - 1)
    return paras.filter(keeps_paragraph("raw")).select(*keys, "para", "off", T.strip_markers("raw").alias("text"))


def page_of(off: T.ColumnLike, chars_per_page: int = fixed.CHARS_PER_PAGE, form_feeds: Column | None = None) -> Column:
    """The page of an offset: by the form feeds before it where the book has any, else by its size."""
    off = F.col(off) if isinstance(off, str) else off
    estimate = (F.floor(off / chars_per_page) + 1).cast("long")
    if form_feeds is None:
        return estimate
    before = (F.size(F.filter(form_feeds, lambda x: x < off)) + 1).cast("long")
    return F.when(F.size(form_feeds) > 0, before).otherwise(estimate)


def form_feeds(c: T.ColumnLike) -> Column:
    """Offsets of the form feeds of a text."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, "\f")
    ends = F.aggregate(parts, F.array(F.lit(-1).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
    return F.slice(ends, F.lit(2), F.size(parts) - 1)


def number_sentences(paragraphs: DataFrame, order: list[str], name: str = "position", sents: str = "sents") -> DataFrame:
    """order, sent and a dense number from 1 of every sentence over the whole table, without a single-task window. Texts are
    split once: paragraphs are written with their numbers of sentences, and these small rows are sorted."""
    sizes = cut(paragraphs.select(*order, F.size(sents).alias("_n")))
    return number_rows(sizes, order, name, each=("_n", "sent"))[0]


def text_lines(c: T.ColumnLike, fold: bool = True, terms: bool = False) -> Column:
    """Array of the lines of a text. With terms, null for most texts none of whose sentences can have a term."""
    c = F.col(c) if isinstance(c, str) else c
    if not terms:
        return F.transform(F.split(c, "\n"), T.fold_accents) if fold else F.split(c, "\n")
    return T.let(T.fold_accents(c) if fold else c, lambda x: F.when(X.may_have_terms(x), F.split(x, "\n")))


def kept_lines(c: T.ColumnLike, fold: bool = True, terms: bool = False) -> Column:
    """Array of the paragraphs (para, the line number, and line) of text_lines() that keeps_paragraph() keeps."""
    rows = F.transform(text_lines(c, fold, terms), lambda x, i: F.struct(i.alias("para"), x.alias("line")))
    return F.filter(rows, lambda r: (r["line"] != "") & keeps_paragraph(r["line"]))


def document_paragraphs(docs: DataFrame, fold: bool = True) -> DataFrame:
    """Documents as chapters of the book of their language: doc_id, lang, para (line number), line and sents."""
    texts = F.split("text", "\n")
    rows = T.unnest(docs, F.transform(texts, T.fold_accents) if fold else texts, "para", "line", ["doc_id", "lang"])
    rows = rows.filter((F.col("line") != "") & keeps_paragraph("line"))
    return rows.withColumn("sents", split_sentences(T.strip_markers("line")))


def document_sentences(docs: DataFrame, fold: bool = True) -> DataFrame:
    return T.unnest(document_paragraphs(docs, fold), "sents", "sent", "sentence", ["doc_id", "lang", "para"])

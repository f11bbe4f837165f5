"""Pages, corpora and word lists as DataFrames, and back to files.

Directories take the place of single files: Spark writes one part for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lutrin.functions.html import RECORD, extractor
from lutrin.functions.text import trim_unicode
from lutrin.session import ship


def _has_pages(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*.htm")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def choose_folder(spark: SparkSession, folder: str | None, default: str) -> str:
    """``folder`` if it holds *.htm files, else ``default``: so for null, blank and wrong ones."""
    own = (folder or "").strip()
    return own if own and _has_pages(spark, own) else default


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, html) of all *.htm files directly in a folder, whole files read as UTF-8."""
    if not folder or not folder.strip():
        raise ValueError("a folder of pages is needed")
    files = spark.read.text(folder.strip(), wholetext=True, pathGlobFilter="*.htm")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def articles_of(pages: DataFrame, html_col: str = "html", **variants) -> DataFrame:
    """The article records of pages, other columns kept. Each page is parsed once. A null page gives a record of nulls.
    ``variants`` are those of ``lutrin.functions.html.extract``."""
    ship(pages.sparkSession)
    keep = [c for c in pages.columns if c != html_col and c not in RECORD.fieldNames()]
    record = pages.select(*keep, extractor(**variants)(F.col(html_col)).alias("record"))
    return record.select(*keep, "record.*")


def image_lists(articles: DataFrame) -> DataFrame:
    """``articles`` with the images as two parallel lists, images_url and images_legend."""
    return articles.select("*", F.col("images.url").alias("images_url"), F.col("images.legend").alias("images_legend")).drop("images")


#: A document of the corpus in XML: images are elements ``image`` and ``legend`` in one element, as many of each.
_DOCUMENT = StructType([*(f for f in RECORD.fields if f.name != "images"), StructField("images", StructType([StructField(n, ArrayType(StringType())) for n in ("image", "legend")]))])
_CORRUPT = "_corrupt_record"


def corpus_records(pages: DataFrame) -> DataFrame:
    """The records that a corpus is built of: those of ``articles_of`` with the title's first own text as it is."""
    return articles_of(pages, first_title_node=True)


def _read_xml(spark: SparkSession, path: str, mode: str, schema: StructType) -> DataFrame:
    reader = spark.read.schema(schema).format("xml").option("rowTag", "document").option("mode", mode).option("ignoreSurroundingSpaces", "false")
    return reader.option("columnNameOfCorruptRecord", _CORRUPT).load(path)


def read_corpus(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Article records from corpus XML (rows are ``document`` elements). Empty elements read back as '', but no article number as null.

    ``tolerant`` leaves out rows that can't be parsed (``corpus_errors`` has them); otherwise they fail the read.
    """
    df = _read_xml(spark, path, "DROPMALFORMED" if tolerant else "FAILFAST", _DOCUMENT)
    pairs = F.arrays_zip(F.col("images.image").alias("url"), F.col("images.legend").alias("legend"))
    images = F.transform(pairs, lambda p: F.struct(p["url"].alias("url"), F.coalesce(p["legend"], F.lit("")).alias("legend")))
    fields = [F.nullif(F.col(c), F.lit("")).alias(c) if c == "article" else F.coalesce(images, F.array().cast(RECORD["images"].dataType)).alias(c) if c == "images" else F.coalesce(F.col(c), F.lit("")).alias(c) for c in RECORD.fieldNames()]
    return df.select(*fields)


def corpus_errors(spark: SparkSession, path: str) -> DataFrame:
    """(record): the documents of corpus XML that can't be parsed, as they stand."""
    df = _read_xml(spark, path, "PERMISSIVE", StructType([*_DOCUMENT.fields, StructField(_CORRUPT, StringType())]))
    # Spark wants another column to be read beside the record.
    nothing = F.substring(F.coalesce("titre", F.lit("")), 1, 0)
    return df.filter(F.col(_CORRUPT).isNotNull()).select(F.concat(_CORRUPT, nothing).alias("record"))


def write_corpus(df: DataFrame, path: str) -> None:
    """Article records as corpus XML; columns of other names are left out. What XML has no sign for, control characters, is too."""
    bad = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
    own = [F.regexp_replace(F.coalesce(F.col(c), F.lit("")), bad, "").alias(c) for c in RECORD.fieldNames() if c in df.columns and c != "images"]
    if "images" in df.columns:
        own.append(F.struct(F.col("images.url").alias("image"), F.transform("images", lambda i: F.coalesce(i["legend"], F.lit(""))).alias("legend")).alias("images"))
    df.select(*own).write.mode("overwrite").format("xml").option("rootTag", "corpus").option("rowTag", "document").save(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line), numbered from 1 in each file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", r"\r?\n"))).select("path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def read_anti_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(ord, token, subst) of a list of lines ``token<TAB>"subst"``.

    Of a token that repeats, the first place counts and the last substitute; lines without exactly one tab are left out.
    """
    parts = F.split(trim_unicode(F.col("line")), "\t")
    rows = _lines(spark, path).filter(F.size(F.split("line", "\t")) == 2)
    subst = F.regexp_replace(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), '^"+|"+$', "")
    rows = rows.select(F.col("line_no").alias("ord"), parts[0].alias("token"), subst.alias("subst"))
    return rows.groupBy("token").agg(F.min("ord").alias("ord"), F.max_by("subst", "ord").alias("subst")).select("ord", "token", "subst")


def write_anti_dictionary(df: DataFrame, path: str) -> None:
    """A list of lines ``token<TAB> "subst"`` in one file, by ``ord`` where there is one, else by token."""
    subst = F.coalesce(F.col("subst"), F.lit("")) if "subst" in df.columns else F.lit("")
    line = F.concat("token", F.lit('\t "'), subst, F.lit('"'))
    df.orderBy(*(["ord"] if "ord" in df.columns else []), "token").coalesce(1).select(line).write.mode("overwrite").text(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, word, lemma) of lines ``word<TAB>lemma``; blank lines and lines without a tab are left out."""
    parts = F.split(trim_unicode(F.col("line")), "\t", 2)
    return _lines(spark, path).filter(F.size(parts) == 2).select("line_no", parts[0].alias("word"), parts[1].alias("lemma"))


def write_pairs(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns separated by tabs, without a header: words with stems or lemmas, frequencies, postings."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns))).write.mode("overwrite").text(path)


def read_last_column(spark: SparkSession, path: str) -> DataFrame:
    """(value): the last of the tab-separated columns of each line."""
    return spark.read.text(path).select(F.element_at(F.split(trim_unicode(F.col("value")), "\t"), -1).alias("value"))


def count_lines(spark: SparkSession, path: str) -> int:
    """Number of lines with anything but white space."""
    return spark.read.text(path).filter(F.col("value").rlike(r"(?U)\S")).count()

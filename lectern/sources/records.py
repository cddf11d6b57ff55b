"""Sources and sinks: JSON feeds with fixed schemas, Parquet tables for vectors, appends and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import adapters
from lectern.registry import register
from lectern.storage import scratch

BOOK = T.StructType([T.StructField("book_id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType()), T.StructField("publication_year", T.LongType()), T.StructField("rating", T.IntegerType())])
COCO = "images array<struct<id: long, file_name: string>>, annotations array<struct<image_id: long, category_id: long, bbox: array<double>>>, categories array<struct<id: long, name: string>>"
SHELF = "samples array<struct<image: string, books: array<struct<id: string, isbn: string, title: string, author: string, bbox: array<double>>>>>"
VOLUME = "id string, volumeInfo struct<title: string, authors: array<string>, publishedDate: string, industryIdentifiers: array<struct<type: string, identifier: string>>, imageLinks: struct<large: string, medium: string, small: string>>"
LIBRARY_DOC = "key string, title string, isbn array<string>, publish_year array<int>, subject array<string>, cover_i long"


def write_books_json(books: DataFrame, path: str) -> None:
    """A JSON object a line, with the fixed fields; quotes and line breaks are escaped, missing values stay out."""
    books.select(*[F.col(f.name).cast(f.dataType) for f in BOOK.fields]).write.json(path)


def append_books(books: DataFrame, path: str) -> None:
    """Append records with the fixed schema; columns beyond it are dropped."""
    books.select(*[F.col(f.name).cast(f.dataType) for f in BOOK.fields]).write.mode("append").parquet(path)


def read_coco(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(image_id, file_name, class_name, x1, y1, x2, y2); images without boxes stay, with nulls.

    A file is one object, or, without whole_files, an object a line: such files are split over tasks.
    """
    feed = spark.read.schema(COCO).json(path, multiLine=whole_files)
    images = feed.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    boxes = feed.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("category_id"), F.col("a.bbox").alias("b"))
    names = feed.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("class_name"))
    x, y, w, h = (F.get("b", F.lit(k)) for k in range(4))
    return images.join(boxes, "image_id", "left").join(names, "category_id", "left").select("image_id", "file_name", "class_name", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def read_shelves(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(image, book_key, expected_text, bbox) of annotated shelves, from one object a file or (without whole_files) a line."""
    rows = spark.read.schema(SHELF).json(path, multiLine=whole_files).select(F.explode("samples").alias("s")).select("s.image", F.explode_outer("s.books").alias("b"))
    return rows.select("image", F.coalesce("b.id", "b.isbn").alias("book_key"), F.concat_ws(" ", "b.title", "b.author").alias("expected_text"), F.col("b.bbox").alias("bbox"))


def flatten_volumes(feed: DataFrame) -> DataFrame:
    """Metadata rows of a volume feed: identifiers by type, first cover there is, year where numeric."""
    v = F.col("volumeInfo")

    def code(kind: str):
        return F.get(F.filter(v["industryIdentifiers"], lambda x: x["type"] == kind), F.lit(0))["identifier"]

    cover = F.regexp_replace(F.coalesce(v["imageLinks"]["large"], v["imageLinks"]["medium"], v["imageLinks"]["small"]), "^http:", "https:")
    return feed.select("id", v["title"].alias("title"), code("ISBN_13").alias("isbn_13"), code("ISBN_10").alias("isbn_10"), cover.alias("cover_url"), F.expr("try_cast(substring(volumeInfo.publishedDate, 1, 4) as int)").alias("year"))


def flatten_library_docs(feed: DataFrame) -> DataFrame:
    """Metadata rows of a search-doc feed: first ISBN of each length, earliest year, ten subjects."""

    def first(n: int):
        return F.get(F.filter("isbn", lambda x: F.length(x) == n), F.lit(0))

    return feed.select("key", "title", first(13).alias("isbn_13"), first(10).alias("isbn_10"), F.array_min("publish_year").alias("year"), F.slice("subject", 1, 10).alias("subjects"), "cover_i")


def save_metrics(metrics: DataFrame, path: str, run: str) -> None:
    metrics.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(path)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """(id, modality, embedding, meta) as Parquet, a folder for each modality: the table is the index."""
    vectors.write.mode("append").partitionBy("modality").parquet(path)


# -- queries: each writes what it made from the tables and reads it back


def _round_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "books")
    books = adapters.view(s, d, "books").where("not is_deleted")
    append_books(books.where("book_id % 2 = 0"), path)
    append_books(books.where("book_id % 2 = 1"), path)
    return s.read.schema(BOOK).parquet(path)


def _json_lines(df: DataFrame, s: SparkSession, name: str) -> str:
    path = scratch(s, name)
    df.write.text(path)
    return path


def _coco(s: SparkSession, d: str) -> DataFrame:
    boxes = adapters.view(s, d, "boxes").withColumn("image_id", F.col("image_id").cast("long"))
    one = boxes.select("image_id", F.struct("image_id", F.ascii("class_name").cast("long").alias("category_id"), F.array("gx1", "gy1", F.col("gx2") - F.col("gx1"), F.col("gy2") - F.col("gy1")).alias("bbox")).alias("a")).groupBy("image_id").agg(F.collect_list("a").alias("annotations"))
    names = F.array(*[F.struct(F.lit(ord(c)).cast("long").alias("id"), F.lit(c).alias("name")) for c in "ANR"])
    docs = one.select(F.to_json(F.struct(F.array(F.struct(F.col("image_id").alias("id"), F.concat(F.lit("f"), F.col("image_id").cast("string")).alias("file_name"))).alias("images"), "annotations", F.when(F.col("image_id") == 1, names).otherwise(F.array()).alias("categories"))).alias("value"))
    return read_coco(s, _json_lines(docs, s, "coco"), whole_files=False)


def _volumes(s: SparkSession, d: str) -> DataFrame:
    b = adapters.view(s, d, "isbn_books")
    info = F.struct("title", F.array("author").alias("authors"), F.col("publication_year").cast("string").alias("publishedDate"), F.array(F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn_13").alias("identifier"))).alias("industryIdentifiers"), F.struct(F.lit(None).cast("string").alias("large"), F.lit("http://covers.example.org/m").alias("medium"), F.lit("http://covers.example.org/s").alias("small")).alias("imageLinks"))
    path = _json_lines(b.select(F.to_json(F.struct(F.col("book_id").cast("string").alias("id"), info.alias("volumeInfo"))).alias("value")), s, "volumes")
    return flatten_volumes(s.read.schema(VOLUME).json(path))


def _library_docs(s: SparkSession, d: str) -> DataFrame:
    b = adapters.view(s, d, "isbn_books")
    row = F.struct(F.col("book_id").cast("string").alias("key"), "title", F.array_compact(F.array("isbn_10", "isbn_13")).alias("isbn"), F.array((F.col("publication_year") + 3).cast("int"), F.col("publication_year").cast("int")).alias("publish_year"), F.col("genres").alias("subject"), F.col("book_id").alias("cover_i"))
    return flatten_library_docs(s.read.schema(LIBRARY_DOC).json(_json_lines(b.select(F.to_json(row).alias("value")), s, "docs"))).withColumn("subjects", F.array_join("subjects", ","))


def _exported(s: SparkSession, d: str) -> DataFrame:
    """Books as JSON and back; some titles have quotes, a backslash, a line break or other scripts."""
    path = scratch(s, "export")
    write_books_json(adapters.query(s, d, ["books"], f"select book_id, {_ODD_TITLE} as title, author, publication_year, rating from books where not is_deleted"), path)
    return s.read.schema(BOOK).json(path)


_ODD_TITLE = "case book_id % 4 when 0 then concat('\"', title, '\" ', chr(92), ' ', chr(10), ' 漢') when 1 then concat(title, chr(13), chr(9), '{[,:]}') else title end"
register("export_books_json", _exported, ["books"], f"select book_id, {_ODD_TITLE} as title, author, cast(publication_year as bigint) as publication_year, rating from books where not is_deleted")
register("bulk_ingest", _round_trip, ["books"], "select book_id, title, author, cast(publication_year as bigint) as publication_year, rating from books where not is_deleted")
register("load_coco_boxes", _coco, ["boxes"], "select cast(image_id as bigint) as image_id, concat('f', cast(image_id as varchar)) as file_name, class_name, gx1 as x1, gy1 as y1, gx2 as x2, gy2 as y2 from boxes")
register("flatten_google_volumes", _volumes, ["isbn_books"], "select cast(book_id as varchar) as id, title, isbn_13, cast(null as varchar) as isbn_10, 'https://covers.example.org/m' as cover_url, cast(publication_year as int) as year from isbn_books")
register("flatten_openlibrary", _library_docs, ["isbn_books"], "select cast(book_id as varchar) as key, title, isbn_13, isbn_10, cast(publication_year as int) as year, array_to_string(genres, ',') as subjects, book_id as cover_i from isbn_books")


def _vector_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "vectors")
    for modality, name in (("text", "embeddings"), ("visual", "visual_vectors")):
        save_vectors(adapters.view(s, d, name).select(F.col("vec_id").alias("id"), F.lit(modality).alias("modality"), "embedding"), path)
    return s.read.parquet(path).groupBy("modality").agg(F.count("*").alias("vectors"))


def _metrics_round_trip(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "metrics")
    save_metrics(adapters.view(s, d, "latency").groupBy("stage").agg(F.count("*").alias("samples"), F.max("ms").alias("slowest")), path, "run-1")
    return s.read.schema("stage string, samples long, slowest double, run string").json(path)


register("vector_table_persist", _vector_round_trip, [], "select modality, count(*) as vectors from (select 'text' as modality from embeddings union all select 'visual' from embeddings) v group by modality")
register("save_metrics_json", _metrics_round_trip, ["latency"], "select stage, count(*) as samples, max(ms) as slowest, 'run-1' as run from latency group by stage")

EVAL = "query_id long, query string, category string, confidence double, candidates array<string>, relevant array<string>"


def read_eval_queries(feed: DataFrame) -> DataFrame:
    """(query_id, query, category, confidence, candidate, place, relevant) with the defaults of missing fields."""
    base = feed.select("query_id", "query", F.coalesce("category", F.lit("general")).alias("category"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.posexplode_outer("candidates").alias("at", "candidate"), F.coalesce("relevant", F.array().cast("array<string>")).alias("r"))
    return base.select("query_id", "query", "category", "confidence", "candidate", (F.col("at") + 1).alias("place"), F.coalesce(F.array_contains("r", F.col("candidate")), F.lit(False)).alias("relevant"))


def _shelves(s: SparkSession, d: str) -> DataFrame:
    b = adapters.view(s, d, "isbn_books")
    book = F.struct(F.when(F.col("book_id") % 2 == 0, F.col("book_id").cast("string")).alias("id"), F.coalesce("isbn_13", F.lit("none")).alias("isbn"), "title", "author", F.array(F.lit(0.0), F.lit(1.0)).alias("bbox"))
    sample = F.struct(F.concat(F.lit("shelf"), (F.col("book_id") % 50).cast("string")).alias("image"), F.array(book).alias("books"))
    path = _json_lines(b.select(F.to_json(F.struct(F.array(sample).alias("samples"))).alias("value")), s, "shelves")
    return read_shelves(s, path, whole_files=False).select("image", "book_key", "expected_text")


def _eval_queries(s: SparkSession, d: str) -> DataFrame:
    q = adapters.view(s, d, "books")
    row = F.struct(F.col("book_id").alias("query_id"), F.col("title").alias("query"), F.when(F.col("book_id") % 3 == 0, F.col("author")).alias("category"), F.when(F.col("book_id") % 2 == 0, F.lit(0.5)).alias("confidence"), F.array(F.col("book_id").cast("string"), F.lit("x")).alias("candidates"), F.when(F.col("book_id") % 5 != 0, F.array(F.col("book_id").cast("string"))).alias("relevant"))
    return read_eval_queries(s.read.schema(EVAL).json(_json_lines(q.select(F.to_json(row).alias("value")), s, "eval")))


register("load_shelf_annotations", _shelves, ["isbn_books"], "select concat('shelf', cast(book_id % 50 as varchar)) as image, case when book_id % 2 = 0 then cast(book_id as varchar) else coalesce(isbn_13, 'none') end as book_key, concat(title, ' ', author) as expected_text from isbn_books")
register(
    "load_eval_queries", _eval_queries, ["books"],
    "select book_id as query_id, title as query, case when book_id % 3 = 0 then author else 'general' end as category, case when book_id % 2 = 0 then 0.5::double else 1.0::double end as confidence, c.candidate, c.place, c.place = 1 and book_id % 5 <> 0 as relevant from books cross join lateral (select cast(book_id as varchar) as candidate, cast(1 as int) as place union all select 'x', 2) c",
)

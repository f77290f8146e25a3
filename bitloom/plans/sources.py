"""Reading and writing: CSV, manifests, stored sketches and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from bitloom.operators import sketch
from bitloom.plans import oracle as o
from bitloom.plans.registry import query
from bitloom.plans.sketches import doc_sketches
from bitloom.sources import files, stores
from bitloom.sources.tables import read_table


@query("csv_scan_select", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_scan_select(spark, folder):
    customer = read_table(spark, folder, "customer")
    path = files.new_folder(spark, "customer-csv")
    files.write_csv(customer, path)
    return files.read_csv(spark, path, customer.schema, ["c_custkey", "c_name", "c_acctbal"])


@query("csv_texts", "SELECT doc_id, text, lang FROM documents UNION ALL SELECT -item_id - 1, '', NULL FROM benchmark")
def csv_texts(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    gaps = read_table(spark, folder, "benchmark").select(
        (-F.col("item_id") - 1).alias("doc_id"), F.lit("").alias("text"), F.lit(None).cast("string").alias("lang")
    )
    both = docs.unionByName(gaps)
    path = files.new_folder(spark, "texts-csv")
    files.write_csv(both, path)
    return files.read_csv(spark, path, both.schema, ["doc_id", "text", "lang"])


@query(
    "csv_write",
    """SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers
    FROM orders WHERE o_totalprice < 200000 GROUP BY 1""",
)
def csv_write(spark, folder):
    orders = read_table(spark, folder, "orders")
    cheap = orders.where("o_totalprice < 200000").select("o_orderpriority", "o_custkey")
    path = files.new_folder(spark, "orders-csv")
    files.write_csv(cheap, path)
    back = files.read_csv(spark, path, cheap.schema, ["o_orderpriority", "o_custkey"])
    return back.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("n_customers")
    )


@query("dir_manifest")
def dir_manifest(spark, folder):
    return files.dir_manifest(spark, folder, "parquet")


@query(
    "staging_manifest",
    """SELECT doc_id, sha1(doc_id::VARCHAR) AS id, lang, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'unsupported'
      WHEN quality IS NULL THEN 'waiting' WHEN quality = 1 THEN 'done' ELSE 'retry' END AS status
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def staging_manifest(spark, folder):
    items = read_table(spark, folder, "documents").select("doc_id", "lang")
    processed = read_table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return files.staging_manifest(items, processed, "doc_id", "lang", ["en", "de", "fr"])


@query("sketch_save", f"WITH {o.doc_sketch('source')} SELECT set_id, 10 AS p, count(*) AS n_registers FROM sk GROUP BY 1")
def sketch_save(spark, folder):
    path = files.new_folder(spark, "sketches")
    stores.save_sketches(doc_sketches(spark, folder, "source"), path, status="b")
    saved = spark.read.parquet(path).where("p = 10 AND status = 'b'")
    return saved.groupBy("set_id", "p").agg(F.count("*").alias("n_registers"))


@query(
    "sketch_load",
    f"""WITH tok AS ({o.tokens('documents', "CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS part, source")}),
    sk AS ({o.sketch('tok', 'source')}) SELECT set_id, bin, word FROM sk""",
)
def sketch_load(spark, folder):
    from bitloom.plans.sketches import doc_words

    words = doc_words(spark, folder, "source", "lang")
    path = files.new_folder(spark, "sketches")
    english = sketch.build(words.where("lang = 'en'"), F.col("source"), F.col("token"))
    stores.save_sketches(english, path, status="t")
    rest = sketch.build(words.where("lang <> 'en'"), F.col("source"), F.col("token"))
    return stores.load_sketches(spark, path, 10, status="t", into=rest).rows

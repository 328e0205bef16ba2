"""Reading claim records, choosing among them, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a claim record is read as; evidences stay a string, as their keys vary.
CLAIM = """claim string, rating string, url string, content string, evidences string, relationship_with_evidence string,
video_information struct<video_url: string, platform: string, video_date: string, video_headline: string, video_description: string, video_transcript: string>"""


#: The folders that a collection of claims has.
SPLITS = ("train_val", "test")


def scan(spark: SparkSession, folder: str, schema: str = CLAIM) -> DataFrame:
    """One row for each JSON file below the folder, with claim_id (file stem), legacy_split (folder) and `broken`: the text of a file that is no JSON object."""
    read = spark.read.schema(f"{schema}, broken string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "broken")
    place = F.col("_metadata.file_path")
    return read.json(folder).select("*", F.regexp_extract(place, r"([^/]+)\.json$", 1).alias("claim_id"), F.regexp_extract(place, r"([^/]+)/[^/]+$", 1).alias("legacy_split"))


def claims(spark: SparkSession, folder: str, schema: str = CLAIM) -> DataFrame:
    """The claim records of a collection; without one of its folders, with a broken file or with an id that stands twice that is an error, which names up to five of them."""
    for split in SPLITS:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}")
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            raise FileNotFoundError(f"Missing annotation directory: {folder}/{split}")
    rows = scan(spark, folder, schema).filter(F.col("legacy_split").isin(*SPLITS))
    for what, wrong in (("Broken record", rows.select("*").filter("broken IS NOT NULL")), ("Duplicate claim ID", repeated_ids(rows))):
        if found := [r.claim_id for r in wrong.limit(5).collect()]:
            raise ValueError(f"{what}: {', '.join(sorted(found))}")
    return rows.drop("broken")


def claim_refs(records: DataFrame, evidences: str = "evidences", key: str = "claim_id") -> DataFrame:
    """key, n, text, refs of each evidence of a record, from 1 to the number that it states.

    evidences is a JSON object with num_of_evidence and evidence1, evidence2, ..., each a list of a text and, where there
    are any, a list of references. Numbers without a list that holds something are left out, as are keys beyond the
    stated number; texts that are no JSON object have none.
    """
    rows = records.select(key, F.try_parse_json(F.col(evidences)).alias("v"))
    rows = rows.select(key, "v", F.try_variant_get("v", "$.num_of_evidence", "int").alias("many")).filter("many > 0")
    each = rows.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("name"), "value"))
    each = each.withColumn("n", F.regexp_extract("name", r"^evidence([1-9]\d*)$", 1).try_cast("int")).filter("n <= many AND schema_of_variant(value) LIKE 'ARRAY%' AND variant_get(value, '$[0]') IS NOT NULL")
    refs = F.coalesce(F.try_variant_get("value", "$[1]", "array<string>"), F.array().cast("array<string>"))
    return each.select(key, "n", F.try_variant_get("value", "$[0]", "string").alias("text"), refs.alias("refs"))


def evidence_counts(records: DataFrame, evidences: str = "evidences", key: str = "claim_id") -> DataFrame:
    """key, n_evidence (as stated), n_found, n_referenced for every record."""
    of = claim_refs(records, evidences, key).groupBy(key).agg(F.count(F.lit(1)).alias("n_found"), F.count_if(F.size("refs") > 0).alias("n_referenced"))
    stated = F.greatest(F.coalesce(F.try_variant_get(F.try_parse_json(F.col(evidences)), "$.num_of_evidence", "int"), F.lit(0)), F.lit(0))
    return records.select(key, stated.alias("n_evidence")).join(of, key, "left").select(key, "n_evidence", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_found", "n_referenced")))


def label_free(records: DataFrame) -> DataFrame:
    """What a verification may see of a record: claim, post_url, transcript, metadata. Ratings, articles and evidence stay out.

    records: claim_id, claim, video_information as of CLAIM; texts are trimmed, empty ones null, and metadata hold only what is there.
    """
    video = lambda f: F.nullif(F.trim(F.col(f"video_information.{f}")), F.lit(""))
    pairs = {"title": "video_headline", "description": "video_description", "platform": "platform", "upload_date": "video_date"}
    told = F.map_filter(F.create_map(*(x for k, f in pairs.items() for x in (F.lit(k), video(f)))), lambda k, v: v.isNotNull())
    return records.select("claim_id", F.trim(F.coalesce("claim", F.lit(""))).alias("claim"), video("video_url").alias("post_url"), video("video_transcript").alias("transcript"), told.alias("metadata"))


def repeated_ids(rows: DataFrame, key: str = "claim_id") -> DataFrame:
    """Ids that stand in more than one record."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def selected(rows: DataFrame, ids: DataFrame, key: str, limit: int = 0) -> DataFrame:
    """The records of the listed ids, the first `limit` by id where a limit is set."""
    chosen = rows.join(ids.select(key).distinct(), key, "left_semi")
    return chosen.orderBy(key).limit(limit) if limit else chosen


def absent(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """Rows to insert: those whose id isn't there yet."""
    return new.join(old.select(key), key, "left_anti")


def write_splits(rows: DataFrame, folder: str, key: str = "claim_id") -> None:
    """Id lists as text, a folder for each split, the ids in order over its files and within them."""
    ids = rows.select(F.col(key).cast("string").alias("value"), "split")
    ids.repartitionByRange("split", "value").sortWithinPartitions("split", "value").write.partitionBy("split").mode("overwrite").text(folder)


def id_differences(records: DataFrame, annotations: DataFrame, key: str = "claim_id") -> DataFrame:
    """key, problem of the ids that stand in only one of two tables (unannotated or unknown) or more than once in the second (repeated)."""
    have = records.select(key).distinct().withColumn("recorded", F.lit(True))
    both = have.join(annotations.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "full_outer")
    problem = F.when(F.col("n").isNull(), "unannotated").when(F.col("recorded").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return both.select(key, problem.alias("problem")).filter("problem IS NOT NULL")

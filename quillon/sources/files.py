"""Scans of landed source files: each gives ``(key, value, retrieved_at)`` rows, ``value`` the record as text or JSON.

Formats: JSON lines, JSON arrays, objects of arrays, nested bundles, pages of
a paginated API, headerless TSV, commented CSV, RSS and Atom, captured tool
output.  Line formats are split by Spark; whole documents are read one per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import short_hash, url_slug


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _raw(df: DataFrame, key: Column, value: Column, retrieved_at: str) -> DataFrame:
    return df.select(key.alias("key"), value.alias("value"), F.lit(retrieved_at).alias("retrieved_at"))


def entity_lines(spark: SparkSession, path: str, retrieved_at: str, limit: int | None = None) -> DataFrame:
    """One entity per line; the key is its id, else a digest of the line."""
    df = _lines(spark, path)
    rows = _raw(df, F.coalesce(F.nullif(F.get_json_object("value", "$.id"), F.lit("")), F.concat(F.lit("record-"), short_hash(F.col("value")))), F.col("value"), retrieved_at)
    return rows.limit(limit) if limit is not None else rows


def places(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    """Headerless TSV of places, no quoting; the key is the first column, the value a JSON of those used."""
    df = _lines(spark, path).select(F.split("value", "\t").alias("c"))
    col = lambda i: F.get("c", F.lit(i))
    value = F.to_json(F.struct(col(0).alias("id"), col(1).alias("name"), col(4).alias("lat"), col(5).alias("lon"), col(8).alias("country"), F.size("c").alias("columns")))
    return _raw(df, col(0), value, retrieved_at)


RSS = "title string, link string, guid string, pubDate string, description string, creator string"
ATOM = "id string, title string, link array<struct<_href:string,_rel:string>>, author struct<name:string>, published string, updated string, summary string"


def feed_entries(spark: SparkSession, path: str, retrieved_at: str, feed: str = "", max_items: int = 100) -> DataFrame:
    """RSS items and Atom entries of landed feeds as one shape; entities in the XML are not expanded by the reader."""
    rss = spark.read.format("xml").option("rowTag", "item").schema(RSS).load(path).where("title is not null or link is not null or guid is not null").select(
        F.coalesce("guid", "link", F.lit("")).alias("id"), "title", "link", F.col("pubDate").alias("published"), F.col("description").alias("summary"), F.col("creator").alias("author")
    )
    atom = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path).where("title is not null or id is not null").select(
        "id", "title", F.get("link", F.lit(0))["_href"].alias("link"), F.coalesce("published", "updated").alias("published"), "summary", F.col("author.name").alias("author")
    )
    rows = rss.unionByName(atom).withColumn("published", entry_date(F.col("published"))).withColumn("feed", F.lit(feed))
    key = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("link"), F.lit(""))
    return _raw(rows, key, F.to_json(F.struct("id", "title", "link", "published", "summary", "author", "feed")), retrieved_at).limit(max_items)


def entry_date(c: Column) -> Column:
    """ISO stamp in UTC of a feed's date, as it stands where it cannot be read."""
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "^[A-Za-z]{3}, *", ""), "(GMT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    at = F.coalesce(rfc, F.try_to_timestamp(c))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), c)


COMPANY = (
    "name:string,company_number:string,jurisdiction_code:string,incorporation_date:string,dissolution_date:string,company_type:string,"
    "current_status:string,registered_address_in_full:string,opencorporates_url:string,registry_url:string,inactive:boolean"
)


def company_pages(spark: SparkSession, path: str, retrieved_at: str, max_pages: int = 5) -> DataFrame:
    """Companies of landed API pages up to the page limit; a malformed page gives none."""
    page = f"results struct<companies:array<struct<company:struct<{COMPANY}>>>,page:int,total_pages:int>"
    df = _documents(spark, path).select(F.from_json("value", page).alias("p")).where(
        F.coalesce(F.col("p.results.page"), F.lit(1)) <= F.least(F.coalesce(F.col("p.results.total_pages"), F.lit(max_pages)), F.lit(max_pages))
    )
    rows = df.select(F.explode("p.results.companies").alias("c")).select("c.company.*")
    return _raw(rows, F.concat_ws("/", "jurisdiction_code", "company_number"), F.to_json(F.struct(*rows.columns)), retrieved_at)


def intrusion_sets(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    """Eligible intrusion sets of a bundle; the key is the external id, else the object's own."""
    obj = (
        "objects array<struct<id:string,type:string,name:string,description:string,aliases:array<string>,revoked:boolean,x_mitre_deprecated:boolean,"
        "external_references:array<struct<source_name:string,external_id:string,url:string>>>>"
    )
    rows = _documents(spark, path).select(F.explode(F.from_json("value", obj)["objects"]).alias("o")).select("o.*")
    no = F.lit(False)
    rows = rows.where((F.col("type") == "intrusion-set") & ~F.coalesce("revoked", no) & ~F.coalesce("x_mitre_deprecated", no))
    gid = F.nullif(F.get(F.filter("external_references", lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"], F.lit(""))
    rows = rows.withColumn("gid", gid)
    return _raw(rows, F.coalesce("gid", "id"), F.to_json(F.struct("id", "gid", "name", "description", "aliases")), retrieved_at)


def json_array(spark: SparkSession, path: str, item: str, key: Column, retrieved_at: str) -> DataFrame:
    """Objects of a JSON array of fields ``item``; what is no object is skipped."""
    texts = _documents(spark, path).select(F.explode(F.from_json("value", "array<string>")).alias("t")).where(F.col("t").startswith("{"))
    df = texts.select(F.from_json("t", f"struct<{item}>").alias("o")).where("o is not null").select("o.*")
    return _raw(df, key, F.to_json(F.struct(*df.columns)), retrieved_at)


def blocklist(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    fields = "ip_address:string,port:string,malware:string,first_seen:string,last_online:string,country:string"
    return json_array(spark, path, fields, F.concat_ws(":", "ip_address", "port"), retrieved_at)


def object_of_arrays(spark: SparkSession, path: str, item: str, value_field: str, retrieved_at: str) -> DataFrame:
    """``{id: [object, ...]}`` documents: one row per object, keyed by a field of it or the id."""
    df = _documents(spark, path).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("record", "items"))
    texts = df.select("record", F.explode("items").alias("t")).where(F.col("t").startswith("{"))
    rows = texts.select("record", F.from_json("t", f"struct<{item}>").alias("o")).where("o is not null").select("record", "o.*")
    return _raw(rows, F.coalesce(F.nullif(F.col(value_field), F.lit("")), F.col("record")), F.to_json(F.struct(*rows.columns)), retrieved_at)


def ioc_records(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    return object_of_arrays(spark, path, "ioc_value:string,ioc_type:string,malware:string,malware_printable:string,first_seen_utc:string,last_seen_utc:string", "ioc_value", retrieved_at)


def url_records(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    return object_of_arrays(spark, path, "url:string,dateadded:string,last_online:string,threat:string", "url", retrieved_at)


def certificate_lines(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    """Commented CSV of date, digest and reason; a reason may hold commas, the header and short rows are skipped."""
    rows = _lines(spark, path).where(~F.col("value").startswith("#")).select(F.split("value", ",", 3).alias("c")).where("size(c) = 3 and c[0] != 'Listingdate'")
    value = F.to_json(F.struct(F.get("c", F.lit(0)).alias("listed"), F.get("c", F.lit(1)).alias("sha1"), F.get("c", F.lit(2)).alias("reason")))
    return _raw(rows, F.get("c", F.lit(1)), value, retrieved_at)


VICTIM = "victim:string,group:string,url:string,domain:string,country:string,activity:string,claim_url:string,description:string,attackdate:string"
GROUP = "name:string,url:string,altname:string,description:string,locations:array<struct<slug:string>>"


def victims(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    return json_array(spark, path, VICTIM, F.coalesce(F.nullif(F.col("url"), F.lit("")), short_hash(F.to_json(F.struct("victim", "group", "attackdate")))), retrieved_at)


def groups(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    return json_array(spark, path, GROUP, F.coalesce(F.nullif(url_slug(F.col("url")), F.lit("")), short_hash(F.to_json(F.struct("name", "altname")))), retrieved_at)


def tool_output(spark: SparkSession, path: str, retrieved_at: str) -> DataFrame:
    """Captured standard output, one record per file, keyed by the file's name."""
    df = spark.read.text(path, wholetext=True).withColumn("f", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return _raw(df, F.col("f"), F.col("value"), retrieved_at)


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Listing of stored objects ``(uri, length, modified)``; their content is not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select(F.col("path").alias("uri"), "length", F.col("modificationTime").alias("modified"))


def febrl(spark: SparkSession, path: str) -> DataFrame:
    """Records of a headed CSV as ``(id, name, birth_date, address)``; blank fields are left out."""
    df = spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path)
    part = lambda *cs: F.concat_ws(" ", *(F.nullif(F.trim(F.col(c)), F.lit("")) for c in cs if c in df.columns))
    return df.select(F.col(df.columns[0]).alias("id"), part("given_name", "surname").alias("name"), part("date_of_birth").alias("birth_date"), part("street_number", "address_1", "suburb", "postcode").alias("address"))


def febrl_pairs(records: DataFrame, negatives: int, seed: int = 42) -> DataFrame:
    """Matches by the shared number of ``rec-N-org`` ids, and some pairs of different numbers drawn by hash within hash buckets."""
    r = records.select("id", F.regexp_extract("id", r"rec-(\d+)", 1).alias("n"))
    l = r.select(F.col("id").alias("left_id"), "n")
    match = l.join(r.select(F.col("id").alias("right_id"), "n"), "n").where("left_id < right_id").select("left_id", "right_id", F.lit("match").alias("label"))
    b = lambda c, s: r.select(F.col("id").alias(c), F.col("n").alias("n" + c), F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(997)).alias("b"))
    other = b("left_id", seed).join(b("right_id", seed + 1), "b").where("left_id < right_id and nleft_id != nright_id")
    return match.unionByName(other.select("left_id", "right_id", F.lit("non_match").alias("label")).orderBy(F.xxhash64(F.lit(seed), "left_id", "right_id")).limit(negatives))

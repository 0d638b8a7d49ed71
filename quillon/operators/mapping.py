"""Mappings of raw records to typed entities. Each takes ``(key, value, retrieved_at)`` rows and a source, and gives entity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as X
from quillon.schema import VALUES

NONE = "array<string>"


def _props(**fields: Column) -> Column:
    """A property map of single or array values without the empty ones."""
    entries = [F.struct(F.lit(k).alias("key"), F.filter(v, lambda x: x.isNotNull() & (F.trim(x) != "")).alias("value")) for k, v in fields.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def _one(c: Column) -> Column:
    return F.array(c.cast("string"))


def entity(schema: str | Column, id_: Column, props: Column, source: str, reliability: str = "B", anchors: Column | None = None) -> list[Column]:
    """Columns of an entity row; the raw record's key is its pointer."""
    prov = F.struct(F.lit(source).alias("source_id"), F.col("retrieved_at"), F.lit(reliability).alias("reliability"), F.concat(F.lit(f"s3://landing/{source.replace(':', '/')}/"), F.col("key")).alias("source_record"))
    return [
        id_.alias("id"), (F.lit(schema) if isinstance(schema, str) else schema).alias("schema"), props.alias("props"), F.array(F.lit(source.partition(":")[2] or source)).alias("datasets"),
        prov.alias("prov"), (anchors if anchors is not None else F.create_map().cast(VALUES)).alias("anchors"),
    ]


def json_of(raw: DataFrame, fields: str) -> DataFrame:
    """Records with their JSON fields as columns; broken ones are left out."""
    return raw.select("key", "retrieved_at", F.from_json("value", fields).alias("p")).where("p is not null").select("key", "retrieved_at", "p.*")


def bulk(raw: DataFrame, source: str) -> DataFrame:
    """Entities that come typed; those without id or schema are dropped."""
    r = json_of(raw, f"id string, schema string, properties {VALUES}").where("id != '' and schema != ''")
    return r.select(*entity(F.col("schema"), F.col("id"), F.coalesce("properties", F.create_map().cast(VALUES)), source))


def feed(raw: DataFrame, source: str) -> DataFrame:
    r = json_of(raw, "id string, title string, link string, published string, summary string, author string").where("trim(coalesce(link, '')) != '' or trim(coalesce(title, '')) != ''")
    ident = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("id", "link", "title")))
    p = _props(title=_one(F.col("title")), sourceUrl=_one(F.col("link")), publishedAt=_one(F.col("published")), summary=_one(F.col("summary")), author=_one(F.col("author")))
    return r.select(*entity("Article", F.concat(F.lit("feed-"), F.sha1(ident)), p, source))


def places(raw: DataFrame, source: str) -> DataFrame:
    r = json_of(raw, "id string, name string, lat string, lon string, country string, columns int").where("columns >= 9 and id != '' and name != ''")
    p = _props(name=_one(F.col("name")), latitude=_one(F.col("lat")), longitude=_one(F.col("lon")), country=_one(F.lower("country")))
    return r.select(*entity("Address", F.concat(F.lit("geonames-"), "id"), p, source, anchors=F.create_map(F.lit("geonames_id"), F.array("id"))))


def companies(raw: DataFrame, source: str) -> DataFrame:
    r = json_of(raw, "name string, company_number string, jurisdiction_code string, incorporation_date string, dissolution_date string, company_type string, current_status string, registered_address_in_full string, opencorporates_url string, registry_url string")
    r = r.where("name != '' and company_number != ''")
    p = _props(
        name=_one(F.col("name")), registrationNumber=_one(F.col("company_number")), jurisdiction=_one(F.col("jurisdiction_code")), incorporationDate=_one(F.col("incorporation_date")), dissolutionDate=_one(F.col("dissolution_date")),
        legalForm=_one(F.col("company_type")), status=_one(F.col("current_status")), address=_one(F.col("registered_address_in_full")), sourceUrl=F.array("opencorporates_url", "registry_url"),
    )
    anchor = F.create_map(F.lit("opencorporates_id"), F.array(F.concat_ws("/", "jurisdiction_code", "company_number")))
    return r.select(*entity("Company", F.concat_ws("-", F.lit("opencorporates"), "jurisdiction_code", "company_number"), p, source, anchors=anchor))


def intrusion_sets(raw: DataFrame, source: str) -> DataFrame:
    r = json_of(raw, "id string, gid string, name string, description string, aliases array<string>").where("name != ''")
    good = F.col("gid").rlike(r"^G\d{4}$")
    alias = F.array_except(F.array_distinct(F.coalesce("aliases", F.array().cast(NONE))), F.array("name"))
    p = _props(name=_one(F.col("name")), alias=alias, description=_one(F.col("description")))
    anchors = F.when(good, F.create_map(F.lit("mitre_gid"), F.array("gid"))).otherwise(F.create_map().cast(VALUES))
    return r.select(*entity("Organization", F.concat(F.lit("mitre-"), F.coalesce(F.when(good, F.col("gid")), F.col("id"))), p, source, anchors=anchors))


def _indicator(r: DataFrame, value: Column, kind: Column, family: Column, first: Column, last: Column, source: str) -> DataFrame:
    known = F.when(~F.lower(F.trim(family)).isin("", "unknown", "malware"), family)
    p = _props(name=_one(value), indicatorValue=_one(value), indicatorType=_one(kind), malwareFamily=_one(known), firstSeen=_one(X.utc_stamp(first)), lastSeen=_one(X.utc_stamp(last)))
    return r.where(F.trim(value) != "").select(*entity("Indicator", X.indicator_id(value), p, source))


def blocklist(raw: DataFrame, source: str) -> DataFrame:
    r = json_of(raw, "ip_address string, port string, malware string, first_seen string, last_online string").where("trim(ip_address) != ''")
    return _indicator(r, F.concat_ws(":", "ip_address", "port"), F.lit("ipv4"), F.col("malware"), F.col("first_seen"), F.col("last_online"), source)


# Kinds of indicators.
KINDS = {"ip:port": "ipv4", "md5_hash": "md5", "sha1_hash": "sha1", "sha256_hash": "sha256"}


def indicators(raw: DataFrame, source: str) -> DataFrame:
    r = json_of(raw, "ioc_value string, ioc_type string, malware string, malware_printable string, first_seen_utc string, last_seen_utc string")
    t = F.lower(F.trim("ioc_type"))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return _indicator(r, F.col("ioc_value"), F.coalesce(F.try_element_at(kinds, t), t), F.coalesce("malware_printable", "malware"), F.col("first_seen_utc"), F.col("last_seen_utc"), source)


def urls(raw: DataFrame, source: str) -> DataFrame:
    r = json_of(raw, "url string, dateadded string, last_online string, threat string")
    return _indicator(r, F.col("url"), F.lit("url"), F.lit(None).cast("string"), F.col("dateadded"), F.col("last_online"), source)


def malware_family(reason: Column) -> Column:
    """Family named in a listing reason, null for the general word."""
    low = F.lower(F.trim(reason))
    cut = F.when(low.endswith(" c&c"), 4).when(low.endswith(" malware distribution"), 21)
    name = F.trim(F.expr("substring(trim(reason), 1, length(trim(reason)) - cut)"))
    return F.when(cut.isNotNull() & (F.lower(name) != "malware"), name)


def certificates(raw: DataFrame, source: str) -> DataFrame:
    r = json_of(raw, "listed string, sha1 string, reason string").where(F.col("sha1").rlike("^[0-9a-fA-F]{40}$"))
    low = F.lower(F.trim("reason"))
    r = r.withColumn("cut", F.when(low.endswith(" c&c"), 4).when(low.endswith(" malware distribution"), 21))
    return _indicator(r, F.lower("sha1"), F.lit("sha1_cert"), malware_family(F.col("reason")), F.col("listed"), F.lit(None).cast("string"), source)


def ransomware(raw: DataFrame, source: str) -> DataFrame:
    """A victim record gives a company, its group and the link between them; a group record the group."""
    r = json_of(raw, "victim string, `group` string, url string, domain string, country string, activity string, claim_url string, description string, attackdate string, name string, altname string, locations array<struct<slug:string>>")
    v = r.where("victim != '' and `group` != ''")
    vid = F.concat(F.lit("victim-"), X.short_hash(F.coalesce("url", "claim_url", F.concat_ws("|", "victim", "group"))))
    gid = lambda c: F.concat(F.lit("ransomware-group-"), X.group_slug(F.col(c)))
    link = F.concat(F.lit("claim-"), X.short_hash(gid("group"), vid, F.coalesce("url", "claim_url", F.lit(""))))
    text = F.when(~X.placeholder_text(F.col("description")), F.col("description"))
    rows = F.array(
        F.struct(*entity("Company", vid, _props(name=_one(F.col("victim")), website=_one(F.col("domain")), country=_one(F.lower("country")), sector=_one(F.col("activity")), description=_one(text)), source)),
        F.struct(*entity("Organization", gid("group"), _props(name=_one(F.col("group")), topics=_one(F.lit("crime.cyber"))), source)),
        F.struct(*entity("UnknownLink", link, _props(subject=_one(gid("group")), object=_one(vid), role=_one(F.lit("ransomware claim")), date=_one(F.col("attackdate")), sourceUrl=_one(F.col("claim_url"))), source)),
    )
    three = v.select(F.explode(rows).alias("e")).select("e.*")
    g = r.where("coalesce(victim, '') = '' and name != ''")
    sites = F.transform(F.filter(F.coalesce("locations", F.array().cast("array<struct<slug:string>>")), lambda s: s["slug"].isNotNull()), lambda s: s["slug"])
    about = F.when(~X.placeholder_text(F.col("description")), F.col("description"))
    one = g.select(*entity("Organization", gid("name"), _props(name=_one(F.col("name")), alias=_one(F.col("altname")), description=_one(about), website=F.array_distinct(sites), topics=_one(F.lit("crime.cyber"))), source))
    return three.unionByName(one)


def posts(raw: DataFrame, source: str) -> DataFrame:
    """Created posts of a social stream as articles; other events give no row."""
    r = json_of(raw, "did string, time_us long, kind string, commit struct<rkey:string,collection:string,operation:string,record:struct<text:string,createdAt:string>>")
    r = r.where("kind = 'commit' and commit.operation = 'create' and commit.collection = 'app.bsky.feed.post' and commit.record.text != ''")
    p = _props(title=_one(F.substring("commit.record.text", 1, 80)), bodyText=_one(F.col("commit.record.text")), author=_one(F.col("did")), publishedAt=_one(F.col("commit.record.createdAt")))
    return r.select(*entity("Article", F.concat(F.lit("bsky-"), F.sha1(F.concat_ws("/", "did", "commit.rkey"))), p, source))


def dig(raw: DataFrame, source: str) -> DataFrame:
    ips = F.array_distinct(F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")))
    return raw.where(F.size(ips) > 0).select(*entity("UserAccount", F.concat(F.lit("dig-"), F.sha1("key")), _props(name=_one(F.col("key")), ipAddress=ips), source))


def nmap(raw: DataFrame, source: str) -> DataFrame:
    ips = F.array_distinct(F.regexp_extract_all("value", F.lit(r'<address addr="([0-9.]+)" addrtype="ipv4"'), 1))
    return raw.where(F.size(ips) > 0).select(*entity("UserAccount", F.concat(F.lit("nmap-"), F.sha1("key")), _props(name=_one(F.col("key")), ipAddress=ips), source))


def whois(raw: DataFrame, source: str) -> DataFrame:
    at = lambda p: F.nullif(F.trim(F.regexp_extract("value", p, 1)), F.lit(""))
    org, country, domain = at(r"(?im)^[ \t]*Registrant Organi[sz]ation:[ \t]*(.+)$"), at(r"(?im)^[ \t]*Registrant Country:[ \t]*(.+)$"), at(r"(?im)^[ \t]*Domain Name:[ \t]*(.+)$")
    r = raw.withColumns({"org": org, "cc": country, "dom": domain}).where("org is not null")
    return r.select(*entity("Organization", F.concat(F.lit("whois-"), F.sha1(F.lower("org"))), _props(name=_one(F.col("org")), country=_one(F.lower("cc")), website=_one(F.lower("dom"))), source))


def enrich_wikidata(entities: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The anchor from the property, else by a name in ``labels (label, item)``, the first item by id."""
    own = X.qid(X.first_value(F.col("props"), "wikidataId"))
    e = entities.withColumn("_q", own).withColumn("_n", F.lower(X.first_value(F.col("props"), "name")))
    if labels is not None:
        found = labels.groupBy(F.lower("label").alias("_n")).agg(F.min("item").alias("_item"))
        e = e.join(found, "_n", "left").withColumn("_q", F.coalesce("_q", X.qid(F.col("_item")))).drop("_item")
    anchored = F.map_concat(F.map_filter("anchors", lambda k, v: k != "wikidata_id"), F.create_map(F.lit("wikidata_id"), F.array("_q")))
    return e.withColumn("anchors", F.when(F.col("_q").isNotNull(), anchored).otherwise(F.col("anchors"))).drop("_q", "_n")


EXTRACTION = "is_event boolean, event_type string, summary string, date string, country string, place string, actors array<struct<name:string,kind:string>>"


def parse_extraction(content: Column) -> Column:
    """The JSON object within a model's answer, null unless it says that there is an event."""
    cut = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    p = F.from_json(F.nullif(cut, F.lit("")), EXTRACTION)
    return F.when(F.coalesce(p["is_event"], F.lit(False)), p)


def clean_actors(actors: Column, most: int = 5) -> Column:
    """The first five actors, and of these the valid ones."""
    valid = F.filter(F.slice(F.coalesce(actors, F.array().cast("array<struct<name:string,kind:string>>")), 1, most), lambda a: F.coalesce(F.trim(a["name"]) != "", F.lit(False)))
    kind = lambda a: F.when(F.lower(a["kind"]) == "person", "Person").when(F.lower(a["kind"]) == "company", "Company").otherwise("Organization")
    return F.transform(valid, lambda a: F.struct(F.substring(F.trim(a["name"]), 1, 160).alias("name"), kind(a).alias("schema")))


def derive(articles: DataFrame, cities: DataFrame, countries: DataFrame, source: str) -> DataFrame:
    """Events, their actors and places from extractions ``(key, id, content, retrieved_at)``.

    ``cities`` is ``(city, lat, lon)`` in lower case, ``countries`` ``(country)``, the
    gazetteers; an actor is one entity per article on purpose.
    """
    a = articles.withColumn("x", parse_extraction(F.col("content"))).where("x is not null").withColumn("actors", clean_actors(F.col("x.actors")))
    a = a.join(cities.select(F.col("city").alias("_c"), F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon")), F.lower(F.trim("x.place")) == F.col("_c"), "left")
    a = a.join(countries.select(F.lower("country").alias("_k")).distinct(), F.lower(F.trim("x.country")) == F.col("_k"), "left")
    prefix = lambda s: F.when(s == "Person", "per-").when(s == "Company", "com-").otherwise("org-")
    actor = lambda n, s: F.concat(prefix(s), F.sha1(F.concat_ws(":", F.col("id"), F.lower(n))))
    addr = F.when(F.col("lat").isNotNull(), F.concat(F.lit("addr-"), F.sha1(F.concat_ws(":", "id", F.lower("x.place")))))
    date = F.when(F.col("x.date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("x.date")).otherwise(F.col("retrieved_at"))
    ids = F.transform("actors", lambda p: actor(p["name"], p["schema"]))
    event = _props(name=_one(F.col("x.event_type")), summary=_one(F.col("x.summary")), date=_one(date), country=_one(F.col("_k")), involved=ids, proof=_one(F.col("id")), addressEntity=_one(addr))
    events = a.select(*entity("Event", F.concat(F.lit("evt-"), F.sha1("id")), event, source))
    p = a.select("key", "retrieved_at", "id", F.explode("actors").alias("p"))
    people = p.select(*entity(F.col("p.schema"), actor(F.col("p.name"), F.col("p.schema")), _props(name=_one(F.col("p.name"))), source))
    spots = a.where(addr.isNotNull()).select(*entity("Address", addr, _props(name=_one(F.col("x.place")), latitude=_one(F.col("lat")), longitude=_one(F.col("lon")), country=_one(F.col("_k"))), source))
    return events.unionByName(people).unionByName(spots)


def prompts(articles: DataFrame) -> DataFrame:
    """Prompt text of ``(id, title, summary, body)``, parts that are missing left out."""
    part = lambda k, c: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{k}: "), F.col(c)))
    return articles.select("id", F.concat_ws("\n", part("Title", "title"), part("Summary", "summary"), part("Body", "body")).alias("prompt"))


def validate(rows: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Entity rows with ``error``, null for a valid one."""
    error = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(~F.col("schema").isin(*known) | F.col("schema").isNull(), "unknown schema").when(F.col("props").isNull(), "no properties")
    return rows.withColumn("error", error)

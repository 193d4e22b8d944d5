"""The product-monitoring tables, presented over the driver's star schema by plain projections.

Each adapter returns a DataFrame in the schema the operators expect; `shelfline.plans.sql` holds the same
definitions as SQL for checking.  Nothing here samples or limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What an Arrow batch of pages may hold; by rows alone ten thousand pages of any size would be one batch.
PAGE_BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "pages":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", PAGE_BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table of few bytes and much work for each row, dealt over all cores; read as it lies it is one or few tasks."""
    return table(spark, sf_dir, name).repartition(2 * spark.sparkContext.defaultParallelism, key)


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("uuid"),
        F.concat(F.lit("site_"), F.col("user_id") % 4).alias("site"),
        (F.col("user_id") % 5 != 0).alias("enabled"),
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks_of(table(spark, sf_dir, "events"))


def checks_of(events: DataFrame) -> DataFrame:
    """Checks from events, a stream or a table."""
    kind, k = F.col("event_type"), F.col("k")
    availability = (
        F.when(kind == "view", "unknown").when(kind == "click", "unavailable").when(kind == "signup", "preorder").when(kind == "purchase", "in_stock")
    )
    status = F.when(k < 6, 403).when(k < 9, 429).when(k < 14, 404).when(k < 18, 503).otherwise(200)
    return events.withColumn("k", _k()).select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("product_uuid"),
        F.when(kind == "error", "error").otherwise("ok").alias("status"),
        availability.alias("availability"),
        F.floor(F.col("value") * 20).cast("int").alias("response_time_ms"),
        F.when(k % 3 == 0, "browser").otherwise("http").alias("fetch_source"),
        status.alias("http_status"),
        F.when(kind != "error", k).alias("confidence"),
        F.col("ts").alias("checked_at"),
    )


def engine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    kind = F.element_at(
        F.array(*[F.lit(x) for x in ("http_error", "network_error", "blocked", "unknown_state", "browser_fallback", "page_missing")]), k % 6 + 1
    )
    rows = table(spark, sf_dir, "events").withColumn("k", _k()).filter((F.col("event_type") == "error") | (k >= 90))
    return rows.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("site_"), F.col("user_id") % 4).alias("source"),
        kind.alias("kind"),
        F.when(k % 6 < 3, "error").otherwise("warning").alias("severity"),
        F.concat(F.lit("u"), F.col("user_id")).alias("product_uuid"),
        F.concat(F.lit("k="), k).alias("detail"),
        F.when(F.col("event_type") == "signup", F.floor(F.col("value") * 10).cast("int")).alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page readings in order: what change detection compares."""
    return readings_of(table(spark, sf_dir, "events"))


def readings_of(events: DataFrame) -> DataFrame:
    """Readings from events, a stream or a table."""
    kind = F.col("event_type")
    availability = (
        F.when(kind == "view", "unknown").when(kind == "click", "unavailable").when(kind == "signup", "preorder").when(kind == "purchase", "in_stock")
        .otherwise("not_listed")
    )
    cents = F.round(F.col("value") * 100).cast("long")
    whole = F.expr("cast(round(value * 100) as bigint) div 100").cast("string")
    price = F.concat(whole, F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    seller = F.when(F.col("event_id") % 7 == 0, "unknown").when(F.col("event_id") % 3 == 0, "third_party").otherwise("official")
    return events.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("product_uuid"),
        F.col("event_id").alias("id"),
        F.col("ts").alias("checked_at"),
        availability.alias("availability"),
        F.when(F.col("event_id") % 5 != 0, price).alias("price"),
        (kind != "error").alias("page_exists"),
        F.when(kind == "signup", F.when(F.col("event_id") % 2 == 0, "request_invite").otherwise("preorder"))
        .when(kind == "purchase", "add_to_cart").otherwise("none").alias("action"),
        seller.alias("seller_type"),
        F.when(seller == "third_party", F.concat(F.lit("seller "), F.col("event_id") % 10)).when(seller == "official", "shop").alias("seller_name"),
    )


def offer_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offer_events_of(table(spark, sf_dir, "lineitem"))


def offer_events_of(lineitem: DataFrame) -> DataFrame:
    """Sightings of offers over time, keyed by canonical_url; from a table or a batch of a stream."""
    cents = F.expr("cast(round(l_extendedprice * 100) as bigint)")
    price = F.concat((F.expr("cast(round(l_extendedprice * 100) as bigint) div 100")).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" €"))
    availability = F.when(F.col("l_linestatus") == "O", "in_stock").when(F.col("l_returnflag") == "R", "unavailable").otherwise("preorder")
    return lineitem.select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("product_uuid"),
        F.concat(F.lit("shop"), F.col("l_suppkey") % 8).alias("site"),
        F.concat_ws("/", F.col("l_partkey").cast("string"), (F.col("l_suppkey") % 8).cast("string")).alias("canonical_url"),
        F.when(F.col("l_linenumber") % 4 != 0, price).alias("price"),
        F.when(F.col("l_linenumber") % 5 != 0, availability).alias("availability"),
        F.when(F.col("l_quantity") > 40, F.concat(F.lit("m"), F.col("l_orderkey"))).alias("monitored_uuid"),
        (F.col("l_quantity") != 13).alias("page_exists"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("seen_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts, some of products that are gone."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("u"), F.col("o_custkey") * 2).alias("product_uuid"),
        F.col("o_orderpriority").alias("change_type"),
        (F.col("o_orderstatus") == "F").alias("notified"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/shots/"), F.col("o_orderkey"))).alias("screenshot_path"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def _gtin(body: F.Column) -> F.Column:
    """A 12-digit body with its check digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, b: a + b)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def catalog_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    body = F.lpad((key * 7919 + 300000000000).cast("string"), 12, "0")
    return spread(spark, sf_dir, "part", "p_partkey").select(
        F.concat(F.lit("p"), key).alias("uuid"),
        F.col("p_name").alias("name"),
        F.when(key % 6 != 0, F.col("p_brand")).alias("brand"),
        F.when(key % 3 != 0, _gtin(body)).alias("ean"),
        F.when(key % 4 == 0, F.concat(F.lit("MPN-"), key)).alias("mpn"),
        F.when(key % 5 == 0, F.concat(F.lit("SKU-"), key)).alias("manufacturer_sku"),
        F.when(key % 7 == 0, F.concat(F.lit("B0"), F.lpad(key.cast("string"), 8, "0"))).alias("asin"),
        F.when(key % 8 == 0, F.concat(F.lit("M"), key)).alias("model_number"),
        F.when(key % 9 == 0, F.lpad(key.cast("string"), 12, "0")).alias("upc"),
        F.when(key % 11 == 0, F.concat(F.lit("978"), F.lpad(key.cast("string"), 10, "0"))).alias("isbn"),
        F.when(key % 13 == 0, F.concat(F.lit("REF-"), key)).alias("manufacturer_ref"),
        F.col("p_type").alias("collection"),
        F.concat(F.lit("2024-0"), key % 9 + 1, F.lit("-15")).alias("release_date"),
        key.alias("created_seq"),
    )


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings to be matched: names with reversed words and stop words, some without identifiers."""
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_suppkey") % 8).alias("shop")).distinct()
    catalog = catalog_products(spark, sf_dir).withColumn("p", F.col("created_seq"))
    own = pairs.join(catalog, F.col("l_partkey") == F.col("p"))
    turned = F.array_join(F.reverse(F.split("name", " ")), " ")
    return own.select(
        F.concat_ws("/", F.lit("d"), F.col("p").cast("string"), F.col("shop").cast("string")).alias("draft_id"),
        F.concat(F.lit("The "), F.when(F.col("shop") % 2 == 0, turned).otherwise(F.upper("name"))).alias("name"),
        F.when(F.col("shop") % 3 != 2, F.col("brand")).alias("brand"),
        F.when(F.col("shop") % 4 == 0, F.col("ean")).alias("ean"),
        F.when(F.col("shop") % 4 == 1, F.col("mpn")).alias("mpn"),
        F.when(F.col("shop") % 4 == 2, F.col("manufacturer_sku")).alias("manufacturer_sku"),
        F.when(F.col("shop") == 5, F.col("asin")).alias("asin"),
        F.when(F.col("shop") == 6, F.col("model_number")).alias("model_number"),
        F.when(F.col("shop") == 3, F.col("upc")).alias("upc"),
        F.when(F.col("shop") == 7, F.col("isbn")).alias("isbn"),
        F.when(F.col("shop").isin(3, 7), F.col("manufacturer_ref")).alias("manufacturer_ref"),
        F.when(F.col("shop") == 2, F.col("release_date")).alias("release_date"),
        F.when(F.col("shop") == 5, F.concat(F.lit(" "), F.upper("collection"))).alias("collection"),
    )


def discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings of listings: every page is seen, every third one twice with a title missing."""
    pages = table(spark, sf_dir, "pages")
    seen = pages.select(
        "page_id", "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("site"),
        F.lit(1).alias("seq"),
    )
    again = seen.filter("page_id % 3 = 0").select(
        "page_id", F.concat(F.col("url"), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x")).alias("url"),
        F.lit("").alias("title"), "site", F.lit(2).alias("seq"),
    )
    return seen.unionByName(again)


def known_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages known before the latest scans, by fingerprint; most of them wait for a decision."""
    key = F.col("page_id")
    status = F.when(key % 10 == 0, "imported").when(key % 10 == 1, "ignored").when(key % 10 == 2, "blocked").otherwise("pending")
    return first_pages(spark, sf_dir).select("fingerprint", "site", status.alias("status"))


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What complete scans saw: three of four pages, and nothing of some sites."""
    return first_pages(spark, sf_dir).filter("page_id % 4 <> 1 and length(site) % 3 <> 0").select("site", "fingerprint")


def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page (page_id) of each site and URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("site"))
    return pages.groupBy("site", F.md5("url").alias("fingerprint")).agg(F.min("page_id").alias("page_id"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article codes as they are found: right and wrong check digits, placeholders, all lengths, separators."""
    key = F.col("p_partkey")
    body = F.lpad((key * 7919 + 300000000000).cast("string"), 12, "0")
    full = _gtin(body)
    wrong = F.concat(body, ((F.substring(full, 13, 1).cast("int") + 1) % 10).cast("string"))
    kinds = [
        full, wrong, F.concat(F.lit("0"), full), F.concat(F.lit("1"), full), body, F.substring(full, 6, 8), F.lit("0000000000000"), F.lit("11111116"),
        F.concat(F.substring(full, 1, 3), F.lit("-"), F.substring(full, 4, 5), F.lit(" "), F.substring(full, 9, 5)), F.lpad(key.cast("string"), 10, "0"),
        F.concat(F.lit("ISBN "), F.lpad(key.cast("string"), 9, "0"), F.lit("x")), F.lit(""), F.lit(None).cast("string"),
    ]
    rows = spread(spark, sf_dir, "part", "p_partkey").withColumn("full", full)
    return rows.select(key.alias("key"), F.posexplode(F.array(*kinds)).alias("kind", "code"))


def identity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about products, told by several sources with differing confidence."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("uuid"), F.when(F.col("l_linenumber") % 2 == 0, "ean").otherwise("brand").alias("field"),
        F.when(F.col("l_quantity") < 5, " ").otherwise(F.concat(F.lit("v"), F.col("l_suppkey"))).alias("value"),
        (F.expr("cast(rint(l_quantity * 3) as int)") - 10).alias("confidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of products at merchants, one row for each try."""
    status = F.when(F.col("l_quantity") > 45, "found").when(F.col("l_quantity") < 8, "error").otherwise("not_found")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey")).alias("product_uuid"), F.concat(F.lit("shop"), F.col("l_suppkey") % 8).alias("site"),
        F.when(F.col("l_linenumber") % 2 == 0, "ean").otherwise("mpn").alias("key_kind"), F.concat(F.lit("k"), F.col("l_partkey")).alias("key_value"),
        status.alias("status"), F.expr("cast(l_quantity * 2 as int)").alias("confidence"),
        F.when(status == "found", F.concat(F.lit("https://shop/"), F.col("l_orderkey"))).when(F.col("l_linenumber") == 1, "").alias("found_url"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("tried_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog products under the names that search keys use, with up to four aliases."""
    key = F.col("created_seq")
    alias = lambda i: F.concat(F.lit(f"alias {i} "), key.cast("string"))
    aliases = F.when(key % 3 == 0, F.array(F.col("name"), alias(1), alias(2), alias(3))).when(key % 3 == 1, F.array(alias(1)))
    return catalog_products(spark, sf_dir).select(
        "uuid", "brand", "ean", "upc", "isbn", "asin", "mpn", "model_number", F.when(key % 10 == 0, F.col("ean")).alias("gtin"),
        F.col("manufacturer_sku").alias("sku"), F.col("manufacturer_ref").alias("manufacturer_part_number"), F.col("name").alias("canonical_name"),
        F.when(key % 12 == 0, " Maker").alias("manufacturer"), aliases.alias("aliases"),
    )


def search_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("not_found"), F.lit("error"), F.lit("found"), F.lit("pending")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey")).alias("product_uuid"),
        status.alias("status"),
        (F.col("c_custkey") % 8).cast("int").alias("attempts"),
        F.explode(F.array(*[F.lit(f"shop{i}") for i in range(3)])).alias("site"),
    )


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages of every kind: what can be bought, how it is priced, and how its data is marked up."""
    key = F.col("key")
    pick = lambda *texts: F.element_at(F.array(*map(F.lit, texts)), (key % len(texts) + 1).cast("int"))
    control = pick(
        "<button>Ajouter au panier</button>", "<a class='cta' href='#'>Précommander</a>", "<input type='submit' value=\"M'alerter\">M'alerter",
        "<button>Ajouter au panier</button><button>Indisponible</button>", "<p>Bientôt disponible</p>", "<p>Just a moment</p>",
    )
    price = pick("<span class='price'>12,90 €</span>", "", "<p>à € 7.50 pièce</p>", "")
    padding = F.when(key % 5 != 0, F.repeat(F.lit("<p>Une fiche longue et calme. </p>"), F.lit(12))).otherwise("")
    number, full = key.cast("string"), F.col("full")
    json_ld = F.concat(
        F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"X","sku":"NO"},{"mainEntity":{"@type":["Thing","Product"],"gtin13":"'), full,
        F.lit('","sku":"sku '), number, F.lit('","brand":{"@type":"Brand","name":"Marque  '), number, F.lit('"},"offers":{"sku":"NOPE"},"releaseDate":"le 2024-05-01T00"}}]}</script>'),
    )
    props = F.concat(F.lit("<div itemscope><meta itemprop='gtin13' content='"), full, F.lit("'><b itemprop='brand'>Marque "), number, F.lit("</b><i itemprop='mpn'>m_"), number, F.lit("</i></div>"))
    metas = F.concat(F.lit("<meta property='product:ean' content='"), full, F.lit("'><meta name='product:mfr_part_no' content='m-"), number, F.lit("'><meta property='og:brand' content='Marque "), number, F.lit("'>"))
    data = F.when(key % 3 == 0, json_ld).when(key % 3 == 1, props).otherwise(metas)
    html = F.concat(
        F.lit("<html lang='fr'><head><title>"), F.col("p_name"), F.lit("</title></head><body>"), data, F.lit("<nav><a href='/'>Ajouter au panier</a></nav>"),
        F.lit("<div id='cookie-bar'>Rupture de stock 99,99 €</div>"), control, price, padding, F.lit("</body></html>"),
    )
    rows = spread(spark, sf_dir, "part", "p_partkey").withColumn("key", F.col("p_partkey"))
    return rows.withColumn("full", _gtin(F.lpad((key * 7919 + 300000000000).cast("string"), 12, "0"))).select("key", "full", html.alias("html"))


def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products as they are configured, with tags as JSON, some of it broken."""
    key = F.col("s_suppkey")
    tags = F.when(key % 3 == 0, F.concat(F.lit('["Drop","a'), key % 5, F.lit('"]'))).when(key % 3 == 1, "[]").otherwise("not json")
    priority = F.element_at(F.array(*map(F.lit, ("low", "normal", "high", "critical"))), (key % 4 + 1).cast("int"))
    created = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(s_suppkey as int))")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), key).alias("uuid"), F.col("s_name").alias("name"), F.concat(F.lit("shop"), key % 8).alias("site"),
        F.concat(F.lit("https://shop/"), key).alias("url"), tags.alias("tags"), (key % 4 != 0).alias("enabled"), priority.alias("priority"),
        (key % 50 + 10).cast("int").alias("check_interval"), created.alias("created_at"),
    )


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings found, with what was decided of them."""
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("imported", "pending", "ignored", "blocked", "gone"))), (key % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), key).alias("fingerprint"), F.concat(F.lit("shop"), F.col("o_custkey") % 8).alias("site"),
        F.concat(F.lit("https://shop/x/Fiche-"), key, F.lit(".html")).alias("url"), F.concat(F.lit("Fiche "), "o_orderpriority", F.lit(" "), key).alias("title"),
        F.when(key % 3 != 0, F.concat(key % 900, F.lit(",50 €"))).alias("price"), status.alias("status"),
        F.when(key % 5 == 0, F.concat(F.lit("s"), key % 100)).alias("product_uuid"), F.col("o_orderdate").cast("timestamp_ntz").alias("first_seen_at"),
    )


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.concat(F.lit("p"), F.col("o_custkey")).alias("product_uuid"), F.concat(F.lit("p"), key % 200).alias("candidate_uuid"),
        (key % 50 + 50).cast("int").alias("score"), status.alias("status"), F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def stored_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches as they are stored, with the time of the next one."""
    retry = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(substring(product_uuid, 2) as int))")
    rows = search_attempts(spark, sf_dir).withColumn("key_kind", F.lit("ean"))
    return rows.withColumn("next_retry_at", F.when(F.col("status").isin("not_found", "error"), retry))


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How pages were fetched: by which way, with what status, refused before or not."""
    rows = table(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    return rows.select(
        F.col("event_id").alias("id"), F.when(k % 4 == 0, "http").when(k % 4 == 1, "browser").when(k % 4 == 2, "api").alias("source"),
        F.when(k < 6, 403).alias("blocked_status"), F.when(k % 7 == 0, 404).otherwise(200).alias("status_code"),
        F.when(k % 5 == 0, True).when(k % 5 != 1, False).alias("fallback"),
    )


#: What a marketplace puts before the article of a page, by page_id modulo their number; {n}, {p} and {t} are the
#: page's number, a price and its title, {a} and {e} its number with eight and thirteen digits.
MARKET_BLOCKS = (
    '<div id="ppd"><div id="rightCol" class="col right"><div id="desktop_buybox" class="box"><span class="a-price"><span class="a-offscreen">{p},99 €</span></span><div id="availability"><span>En stock</span></div><input id="add-to-cart-button" type="submit" value="Ajouter au panier"><div id="merchant-info">Vendu par Amazon</div></div></div><h1 id="title"><span id="productTitle">{t}</span></h1></div>',
    '<div id="dp"><div id="buybox" class="empty"></div><div id="rightCol" class="col"><div id="availability">Actuellement indisponible.</div></div><span id="productTitle">{t}</span></div>',
    '<div id="desktop_buybox"><div id="corePrice_feature_div"><span class="a-offscreen">1 {p}.50 €</span></div><div id="merchant-info">Vendu par Boutique {n} / Expédié par Amazon</div><input id="buy-now-button" type="submit" value="Acheter maintenant"></div><div id="buybox"><input name="submit.add-to-cart" type="submit" value="Ajouter au panier"></div><div id="qualifiedBuybox"><p>{t}</div><span id="productTitle">{t}</span>',
    '<div class="a-carousel wide"><ul><li><a href="/x{n}">Demander une invitation</a><li><span>Ajouter au panier</span><li><div><h2><a href="/Coffret/dp/B1{a}/ref=1">{t}</a></h2><span class="a-price"><span class="a-offscreen">1 {p},00 €</span></span><img src="https://i.example/{n}.jpg"></div></ul></div><div id="dp"><span class="a-price"><span class="a-offscreen">{p},00 €</span></span></div>',
    '<div id="ppd"><span class="a-price"><span class="a-offscreen">{p},10 €</span></span><button id="add-to-cart-button">Ajouter au panier</button><h1 id="title">{t}</h1></div><div class="extra block wide"><span>Disponible sur invitation {n}</span></div>',
    '<div id="buyBoxAccordion"><span id="hdp-invite-button"><button class="a-button" aria-label="Demander une invitation">Voir</button></span><div id="availability"><span>Sur demande</span></div><div id="price_inside_buybox">{p},25 €</div></div><span id="productTitle">{t}</span>',
    "",
    '<div id="dp-container"><div id="newBuyBoxPrice">$ {p}.75</div><input id="invite-{n}" type="submit" value="Request an invite"><button>QWxhZGRpbjpvcGVuIHNlc2FtZQ</button><button>Voir les avis</button><a href="/l">bcdf {n}</a><a href="/l">Comparer</a></div><h1 id="title">{t}</h1>',
    '<form action="/errors/validateCaptcha"><input type="submit" value="Continuer"></form><div id="desktop_buybox"><input id="add-to-cart-button" type="submit" value="Ajouter au panier"></div>',
    '<div id="centerCol"><p><b>{t}<div class="a-price"><i class="a-offscreen">{p},05 €</i></div><input type="submit" name="submit.add-to-cart" value="Précommander cet article {n}"></p><div id="availability">Sortie prochaine</div><ul><li>Edition : Collector {n}<li>Format : Poche</ul></div>',
    '<div id="dp"><div id="desktop_buybox"><div class="x sponsored-box"><input id="add-to-cart-button" type="submit" value="Ajouter au panier"><span>Demander une invitation</span></div></div><div id="outOfStock"><p>Temporairement en rupture de stock</div><h1 id="title"><span>{t}</span></h1></div>',
    '<div id="dp" class="page main"><span class="a-price"><span class="a-offscreen">{p},30 €</span></span><p class="soon">Cet article sera <i>bientôt disponible</i> {n}</p><div id="variation_size_name"><b class="selection">Taille {n}</b></div><div id="merchant-info">Vendeur : Amazon Amazon</div><span id="productTitle">{t}</span><p itemprop="brand">Marque {n}</p><p itemprop="mpn">data {n}</p><table><tr><th>Marque :</th><td>Fabrique {n}</td></tr><tr><th>Numéro de pièce fabricant</th><td>zz {n}</td></tr><tr><th>Code EAN</th><td>{e}</td></tr><tr><th>Date de sortie</th><td>le 1/9/2026</td></tr><tr><td>Seule</td></tr></table></div>',
)
#: Where a marketplace says that it delivers, by page_id modulo their number; empty: it says nothing.
DELIVERIES = ("Paris 75001", "France", "", "Livraison en Belgique", "Berlin, Deutschland", "", "à Lyon 69002")
MARKET_HOSTS = ("www.amazon.fr", "www.amazon.fr", "www.amazon.de")
MARKET_TLDS = ["fr", "de", "co.uk", "com", "es"]


def market_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as a marketplace would serve them: their own markup and text, with a block before the article."""
    n = F.col("page_id")
    pick = lambda of: F.element_at(F.array(*map(F.lit, of)), (n % len(of) + 1).cast("int"))
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    block = pick(MARKET_BLOCKS)
    for mark, value in (("{n}", n.cast("string")), ("{p}", (n % 900 + 100).cast("string")), ("{t}", title), ("{a}", F.lpad(n.cast("string"), 8, "0")), ("{e}", F.lpad((n * 10).cast("string"), 13, "4"))):
        block = F.replace(block, F.lit(mark), value)
    data = F.when(n % 2 == 0, '<script type="application/ld+json">{"@type":"Product"}</script>').otherwise("")
    where = pick(DELIVERIES)
    glow = F.when(where != "", F.concat(F.lit('<div id="nav-global-location-slot"><span id="glow-ingress-line2">'), where, F.lit("</span></div>"))).otherwise("")
    html = F.replace(F.replace("html", F.lit("<nav>"), F.concat(glow, data, F.lit("<nav>"))), F.lit("<article>"), F.concat(block, F.lit("<article>")))
    url = F.concat(F.lit("https://"), pick(MARKET_HOSTS), F.lit("/dp/B0"), F.lpad(n.cast("string"), 8, "0"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), html.alias("html"))


def listed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue before arrivals: every third part, with some of its identifiers."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter("p_partkey % 3 = 0").select(
        F.concat(F.lit("p"), key).alias("uuid"), F.col("p_name").alias("name"), F.when(key % 4 != 0, F.col("p_brand")).alias("brand"),
        F.when(key % 2 == 0, F.concat(F.lit("E"), key)).alias("ean"), F.when(key % 5 == 0, F.concat(F.lit("M"), F.expr("p_partkey div 2"))).alias("mpn"),
        F.lit(None).cast("string").alias("manufacturer_sku"), key.alias("created_seq"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings in the order shops first sold a part: each shop tells other identifiers, and two parts share an mpn."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 8).alias("shop")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    rows = first.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    key, shop = F.col("p_partkey"), F.col("shop")
    turned = F.array_join(F.reverse(F.split("p_name", " ")), " ")
    return rows.select(
        F.concat_ws("/", F.lit("a"), key.cast("string"), shop.cast("string")).alias("draft_id"), "seq",
        F.concat(F.lit("Neuf "), F.when(shop % 2 == 0, turned).otherwise(F.col("p_name"))).alias("name"), F.when(shop % 3 != 2, F.col("p_brand")).alias("brand"),
        F.when(shop.isin(0, 3, 6, 7), F.concat(F.lit("E"), key)).alias("ean"), F.when(shop.isin(1, 3), F.concat(F.lit("M"), F.expr("p_partkey div 2"))).alias("mpn"),
        F.when(shop.isin(2, 6, 7), F.concat(F.lit("S"), key)).alias("manufacturer_sku"),
    )


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted suggestions as merges, in the order of their ids."""
    return suggestions(spark, sf_dir).filter("status = 'accepted'").select("id", F.col("product_uuid").alias("source"), F.col("candidate_uuid").alias("target"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites of all pages, each with the first of its addresses."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("site")).agg(F.min("url").alias("base_url"))


def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt and site maps of all sites: an index that names itself, maps of pages, some that name other maps.

    A site's home is that of its first address; pages are dealt to five maps by their numbers, in that order.
    """
    home = F.regexp_extract("base_url", "^([a-z]+://[^/]+)", 1)
    own = sites(spark, sf_dir).select("site", home.alias("home"), (F.length("site") % 4).alias("kind"))
    loc = lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("site"), (F.col("page_id") % 5).alias("part"))
    listed = pages.groupBy("site", "part").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("of"))
    listed = listed.join(own, "site").select(
        F.concat("home", F.lit("/map-"), "part", F.lit(".xml")).alias("url"),
        F.concat(F.lit("<urlset>"), F.when(F.col("part") == 1, loc(F.concat("home", F.lit("/Extra.XML")))).otherwise(""), F.array_join(F.transform("of", lambda p: loc(F.replace(p["url"], F.lit("&"), F.lit("%26")))), "\n"), F.lit("</urlset>")).alias("body"),
    )
    parts = F.array_join(F.transform(F.array(*map(F.lit, (3, 0, 9, 1, 4, 2))), lambda i: loc(F.concat("home", F.lit("/map-"), i.cast("string"), F.lit(".xml")))), "")
    index = own.select(F.concat("home", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<?xml?><SitemapIndex>"), loc(F.concat("home", F.lit("/sitemap.xml"))), parts, F.lit("</SitemapIndex>")).alias("body"))
    extra = own.select(F.concat("home", F.lit("/Extra.XML")).alias("url"), F.concat(F.lit("<urlset>"), loc(F.concat("home", F.lit("/special"))), loc(F.concat("home", F.lit("/sitemap.xml"))), F.lit("</urlset>")).alias("body"))
    robots = own.filter("kind <> 0").select(
        F.concat("home", F.lit("/robots.txt")).alias("url"),
        F.when(F.col("kind") == 1, F.concat(F.lit("User-agent: *\n  SITEMAP: "), "home", F.lit("/map-2.xml\nSitemap: "), "home", F.lit("/sitemap.xml\nsitemap:"), "home", F.lit("/map-2.xml"))).otherwise("User-agent: *").alias("body"),
    )
    return listed.unionByName(index).unionByName(extra).unionByName(robots)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What searches would find, in the order of their keys; some keys a merchant can't be asked by."""
    found = tries(spark, sf_dir)
    return found.select("product_uuid", "site", "key_kind", "seq", F.when(F.col("seq") % 11 == 0, "unsupported").otherwise(F.col("status")).alias("status"), "confidence", "found_url")


def market_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of articles in all the forms they are found in, and pages' own addresses."""
    n = F.col("page_id")
    article = F.concat(F.lit("B0"), F.lpad(n.cast("string"), 8, "0"))
    tld = F.element_at(F.array(*map(F.lit, MARKET_TLDS)), (n % len(MARKET_TLDS) + 1).cast("int"))
    url = (
        F.when(n % 6 == 0, F.concat(F.lit("https://WWW.Amazon."), tld, F.lit("/Coffret-Rare/dp/"), F.lower(article), F.lit("/ref=x?th=1#top")))
        .when(n % 6 == 1, F.concat(F.lit("http://amazon."), tld, F.lit("/gp/product/"), article))
        .when(n % 6 == 2, F.concat(F.lit("https://www.amazon."), tld, F.lit("/s?k="), n, F.lit("&asin="), article, F.lit("#f")))
        .when(n % 6 == 3, F.concat(F.lit("https://www.amazon."), tld, F.lit("/dp/SHORT"), n, F.lit("?language=es_US")))
        .when(n % 6 == 4, F.col("url")).otherwise(F.concat(F.lit("https://notamazon."), tld, F.lit("/dp/"), article))
    )
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"))


def market_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text for every page: prices, dates, sellers, titles, tokens."""
    n, title = F.col("page_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    text = (
        F.when(n % 7 == 0, F.concat(F.lit("Prix : 1 "), n % 900 + 100, F.lit(",99 € le "), n % 28 + 1, F.lit("/"), n % 12 + 1, F.lit("/2026")))
        .when(n % 7 == 1, F.concat(title, F.lit(" $"), n % 97, F.lit(".50, release 2026-08-"), n % 20 + 10, F.lit(" or 1.2.2020")))
        .when(n % 7 == 2, F.concat(F.lit("£"), n % 97, F.lit(".99 on "), n % 9 + 1, F.lit("-4-2025"))).when(n % 7 == 3, title)
        .when(n % 7 == 4, F.concat(F.lit("Vendu par : "), title, F.lit(" "), title, F.lit(" Expédié par Autre"))).when(n % 7 == 5, F.concat(F.lit("sans prix "), n, F.lit(" €"))).otherwise(F.md5(title))
    )
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), text.alias("text"))


def delivery_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of destinations: all known countries in turn, postcodes, a word of the page between."""
    from shelfline.functions.market import COUNTRIES

    n = F.col("page_id")
    name = F.element_at(F.array(*[F.lit(c) for c, _ in COUNTRIES]), (n % len(COUNTRIES) + 1).cast("int"))
    word = F.get(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " "), 0)
    label = (
        F.when(n % 5 == 0, F.concat(F.lit("Livrer à "), name)).when(n % 5 == 1, F.concat(F.lit("Deliver to : "), F.upper(name)))
        .when(n % 5 == 2, F.concat(F.lit("  Livraison à "), n * 37 % 90000 + 10000, F.lit(" "), word)).when(n % 5 == 3, F.concat(F.lit("Livrer à 75001 "), name))
        .otherwise(F.concat(F.lit("vers "), word, F.lit(" "), name, F.lit(" demain")))
    )
    return table(spark, sf_dir, "pages").select("page_id", label.alias("label"))


def analysed_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages of offers were found to say, one for each line of an order."""
    from shelfline.functions.market import STATES

    line = F.col("l_linenumber")
    action = F.element_at(F.array(*map(F.lit, STATES)), ((F.col("l_orderkey") + line) % len(STATES) + 1).cast("int"))
    seller = F.when(F.col("l_suppkey") % 3 == 0, "Amazon EU").when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("Boutique "), "l_suppkey")).otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + line).alias("id"), action.alias("action"), seller.alias("seller"), F.expr("cast(l_quantity * 2 as int)").alias("confidence"),
        F.when(line % 4 == 1, "US").when(line % 4 != 3, "FR").alias("country"),
    )


def catalog_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of discovery and of the catalogue about watched products, and others that tell no story."""
    kinds = ("catalog_created", "catalog_merged", "catalog_pending", "discovery_found", "discovery_imported", "http_error", "screenshot")
    k = F.col("event_id") % len(kinds)
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id")).alias("product_uuid"), F.element_at(F.array(*map(F.lit, kinds)), (k + 1).cast("int")).alias("kind"),
        F.when(k != 2, F.concat(F.lit("e="), "event_id")).alias("detail"), F.col("ts").alias("created_at"),
    )


def resightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further sightings of discovered listings, and of listings that aren't known yet."""
    key = F.col("l_orderkey") + F.when(F.col("l_linenumber") % 5 == 0, 10**9).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("f"), key).alias("fingerprint"), F.concat(F.lit("shop"), F.col("l_suppkey") % 8).alias("site"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("Titre "), "l_partkey")).otherwise("").alias("title"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("https://i.example/"), "l_partkey")).alias("image_url"), F.when(F.col("l_quantity") < 20, F.concat(F.col("l_suppkey"), F.lit(",00 €"))).alias("price"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("seen_at"), F.expr("((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey % 8 * 60 + cast(l_quantity as int)").alias("seq"),
    )

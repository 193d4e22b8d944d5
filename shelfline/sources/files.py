"""Sources beside Parquet: product configuration in YAML, saved states in JSON, JDBC tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ("low", "normal", "high", "critical")
CONFIG = "uuid string, name string, site string, url string, check_interval int, enabled boolean, priority string, tags array<string>"


def work_dir(spark: SparkSession, kind: str) -> str:
    """A new path below the shared folder that spark.checkpoint.dir names; only local sessions may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back, for results that several jobs read."""
    path = work_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def products_yaml(spark: SparkSession, text: str) -> DataFrame:
    """Products of a YAML document; ValueError for missing fields, unknown priorities and repeated keys."""
    import yaml

    rows, seen = [], set()
    for item in (yaml.safe_load(text) or {}).get("products", []):
        missing = [k for k in ("name", "site", "url") if not item.get(k)]
        if missing:
            raise ValueError(f"product without {', '.join(missing)}: {item}")
        priority = item.get("priority", "normal")
        if priority not in PRIORITIES:
            raise ValueError(f"unknown priority {priority!r}")
        key = (item["site"], "".join(c if c.isalnum() else "-" for c in item["name"].lower()).strip("-"))
        if key in seen:
            raise ValueError(f"repeated product {key}")
        seen.add(key)
        tags = list(dict.fromkeys(str(t).strip().lower() for t in item.get("tags") or [] if str(t).strip()))
        rows.append(("--".join(key), item["name"], item["site"], item["url"], max(10, int(item.get("check_interval", 60))), bool(item.get("enabled", True)), priority, tags))
    return spark.createDataFrame(rows, CONFIG)


def saved_states(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots kept as JSON files; unreadable ones are left out, so their products start anew."""
    schema = "product_uuid string, availability string, price string, page_exists boolean, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).filter(F.col("product_uuid").isNotNull()).drop("_corrupt_record")


def absent_only(states: DataFrame, known: DataFrame) -> DataFrame:
    """Saved states of products that have no snapshot yet."""
    return states.join(known.select("product_uuid"), "product_uuid", "left_anti")


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def seeded(existing: DataFrame, configured: DataFrame) -> DataFrame:
    """The products that are stored; where there are none yet, those that are configured."""
    return configured if existing.isEmpty() else existing


MODES = ("auto", "review", "rules")


def discovery_settings(text: str | None) -> dict:
    """What a YAML document says of discovery, each value within its bounds; nothing readable leaves discovery off.

    Unknown modes mean review, unknown priorities normal; site names, tags and modes are lower-cased.
    """
    import yaml

    from shelfline.operators.resolution import rules_of

    try:
        raw = yaml.safe_load(text or "") or {}
        defaults = raw.get("defaults") or {}
        mode, priority = str(raw.get("mode", "review")).strip().lower(), str(defaults.get("priority", "high")).strip().lower()
        tags = [str(t).strip().lower() for t in defaults.get("tags") or ["auto-découvert"] if str(t).strip()]
        sites = {str(name).strip().lower(): dict(site or {}) for name, site in (raw.get("sites") or {}).items()}
        return {
            "enabled": bool(raw.get("enabled", False)), "mode": mode if mode in MODES else "review", "scan_interval": max(60, int(raw.get("scan_interval", 900))),
            "max_new_per_scan": max(1, int(raw.get("max_new_per_scan", 50))), "rules": rules_of(raw.get("rules")),
            "defaults": {"check_interval": max(10, int(defaults.get("check_interval", 60))), "priority": priority if priority in PRIORITIES else "normal", "tags": tags, "enabled": bool(defaults.get("enabled", True))},
            "sites": {name: {"enabled": bool(site.pop("enabled", True)), "options": site} for name, site in sites.items()},
        }
    except (yaml.YAMLError, ValueError, TypeError, AttributeError):
        return discovery_settings("") if text else {}

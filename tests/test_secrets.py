"""Secrets are found in every spelling, with one lower-case copy of the text."""

from pyspark.sql import functions as F

from palimpsest.fixed_values import SECRET_FAMILIES
from palimpsest.functions import secrets
from palimpsest.operators import secrets_history

LONG = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
TEXTS = [
    None, "", "nothing here", f"PASſWORD = {LONG} pwd:{LONG}", f"apı_key={LONG} API-KEY: '{LONG}'", f"ACCESS_TOKEN={LONG}", f"aUthorization: Bearer {LONG}",
    f"x-agent-toKen={LONG}", f"cookie_ſecret={LONG}", f"GHP_{LONG} xoxb-{LONG}", f"SK-{LONG} pk_live_{LONG}", f"akia{'Z9' * 8} aws secret key = {LONG}{LONG}",
    f"HTTP://user:{LONG}@db", f"SG.{LONG}.{LONG}", "-----begin private key-----", "tskey-api-" + LONG, "GOCSPX-" + LONG, f"123456-{LONG.lower()}.apps.googleusercontent.com",
]


def test_counts_equal_plain_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    lowered = F.lower("content")
    found = rows.select("id", *[c.alias(n) for n, c in secrets.family_counts(F.col("content"), lowered).items()]).collect()
    plain = rows.select("id", *[F.coalesce(F.regexp_count("content", F.lit("(?Uiu)" + p)), F.lit(0)).alias(n) for n, p in SECRET_FAMILIES.items()]).collect()
    assert sorted(found) == sorted(plain)
    assert all(sum(r[n] for r in plain) for n in SECRET_FAMILIES)
    assert secrets_history.family_totals(rows, "id", "content").count() > 10


def test_redaction_lowers_a_text_once(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string")
    redacted = rows.select("id", secrets.redact(F.col("content")).alias("text"))
    assert redacted._jdf.queryExecution().optimizedPlan().toString().count("lower(content") == 1
    texts = {r.id: r.text for r in redacted.collect()}
    assert [texts[i] for i in range(3)] == TEXTS[:3]
    assert not [t for i, t in texts.items() if i in (3, 4, 5, 6, 7, 8, 12) and LONG in t]

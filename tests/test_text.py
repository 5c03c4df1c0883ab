"""Text, request and path functions on hand-made inputs."""

import html
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import noise, paths, requests, secrets, text


def values(spark, inputs, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("x"))).collect()]


K = "k" * 24


def test_redaction_families(spark):
    hidden = [
        "GOC" + "SPX-" + K, "123456-" + K + ".apps.googleusercontent.com", "tskey-" + "api-" + K, "AK" + "IA" + "A" * 16,
        "sk-" + K, "xox" + "b-" + K, "gh" + "p_" + "a" * 36, "github" + "_pat_" + "a" * 36, "sk-" + "ant-" + K,
        "sk_" + "live_" + K, "pk_" + "test_" + K, "SG." + K + "." + K, "-----BEGIN RSA " + "PRIVATE KEY-----",
    ]
    assert values(spark, hidden, secrets.redact) == ["[REDACTED]"] * len(hidden)


def test_redaction_keeps_surroundings(spark):
    given = [
        "user pass" + "word: hunter22 ok", "Authorization: Bearer " + K + " end", "api_key='" + K + "'",
        "postgres://me:" + "s3cr3tpw@host/db", "cookie_secret = " + K + "==", "X-Agent-Token: " + K,
        "AWS_SECRET_ACCESS_KEY=" + "a" * 40, "PASS" + "WD=abcdef PWD=ghijkl", "plain text", "", None,
        "paſſ=longvalue",
    ]
    assert values(spark, given, secrets.redact) == [
        "user password: [REDACTED] ok", "Authorization: Bearer [REDACTED] end", "api_key='[REDACTED]'",
        "postgres://me:[REDACTED]@host/db", "cookie_secret = [REDACTED]", "X-Agent-Token: [REDACTED]",
        "AWS_SECRET_ACCESS_KEY=[REDACTED]", "PASSWD=[REDACTED] PWD=[REDACTED]", "plain text", "", None,
        "paſſ=[REDACTED]",
    ]


def test_redaction_is_stable_on_its_output(spark):
    once = values(spark, ["password=" + "hunter22 token", "bearer: " + K], secrets.redact)
    assert values(spark, once, secrets.redact) == once


def test_custom_patterns(spark):
    custom = secrets.load_custom_patterns(["# note", "", "ACME-[A-Z]{4}", "id=(\\d+);", "(broken"])
    found = values(spark, ["ACME-ABCD id=77; x"], lambda c: secrets.redact(c, custom))
    assert found == ["[REDACTED] id=[REDACTED]; x"]


def test_html(spark):
    given = ["<p>Hello</p>", "Hello<br>World", "<b>bold</b> text", "a &amp; b &lt;c&gt;", "x<style>p{}</style><SCRIPT>1</SCRIPT>y", "a  \t b", "&nbsp;a"]
    assert values(spark, given, text.html_to_text) == ["Hello", "Hello\nWorld", "bold text", "a & b <c>", "xy", "a b", "a"]


def test_emoji(spark):
    given = ["\U0001f44d", "❤", "<3", "+", "hi", "ok", "", None, "  ", "❤" * 11]
    assert values(spark, given, text.is_single_emoji) == [True, True, False, True, False, False, False, False, False, False]


def test_tokens_match_the_driver(spark):
    given = ["Café user_id", "foo-bar", "日本語 ok", "été", "Straße 12x", "ệ"]
    found = values(spark, given, lambda c: text.tokens_of_folded(text.folded(c)))
    assert found == [text.py_tokens(g) for g in given]
    assert found[0] == ["cafe", "user", "id"] and found[3] == ["ete"] and found[5] == ["ệ"]


def test_noise(spark):
    given = [
        "HEARTBEAT_OK", "NO_REPLY", "You are running a boot check now", "Gateway restarted — back online",
        "x OpenClaw Health Check Report", "Let me check the gateway configuration", "HEARTBEAT_OK!",
        "then gateway restarting\nreconnect", "then gateway restarting, reconnect", None,
    ]
    assert values(spark, given, noise.noise_reason) == [
        "Heartbeat ping", "No-reply marker", "Boot check prompt", "Gateway restart status",
        "Health check webhook", None, None, None, "Gateway restart status", None,
    ]
    assert values(spark, given, noise.stored_noise_reason)[8] is None


def test_mail_and_document_noise(spark):
    mail = spark.createDataFrame(
        [("a@netflix.com", "hi"), ("Bob <bob@firm.de>", "Minutes"), ("b@c.de", "Your  order 5"), ("b@c.de", "Password  Reset")],
        "sender string, subject string",
    )
    assert [r[0] for r in mail.select(noise.is_mail_noise(F.col("sender"), F.col("subject"))).collect()] == [True, False, True, True]
    files = spark.createDataFrame(
        [("image/png", "a"), ("text/plain", "X.MIN.JS"), ("text/plain", "notes.txt"), ("odd/type", "plan.sketch")],
        "mime string, name string",
    )
    assert [r[0] for r in files.select(noise.is_document_noise(F.col("mime"), F.col("name"))).collect()] == [True, True, False, True]


def test_routing(spark):
    asked = {
        "ACME42": False, "act_12345": False, '"exact words here?"': False, "docs/guide what": False,
        "what did we discuss about playbooks": True, "how does the API work": True, "why": True,
        "release 1.2.3 what": False, "long text without any question": False, "anything new?": False,
        "is there anything new?": True,
    }
    assert [requests.wants_semantic(q) for q in asked] == list(asked.values())
    assert values(spark, list(asked), requests.wants_semantic_column) == list(asked.values())


def test_requests():
    assert requests.parse_since("60m") == pytest.approx(1 / 24)
    assert (requests.parse_since("2 hours"), requests.parse_since("3d")) == (2 / 24, 3)
    with pytest.raises(ValueError):
        requests.parse_since("soon")
    now = datetime(2026, 3, 8, 15, 30)
    assert requests.parse_date("today", now) == datetime(2026, 3, 8)
    assert requests.parse_date("Yesterday", now) == datetime(2026, 3, 7)
    assert requests.parse_date("2026-02-01 10:30", now) == datetime(2026, 2, 1, 10, 30)
    assert requests.end_of_range("2026-02-01", now) == datetime(2026, 2, 1, 23, 59, 59)
    with pytest.raises(ValueError):
        requests.parse_date("01.02.2026", now)
    assert [requests.clamp(v, 30, 1, 120) for v in ("x", "0", 999, None, "45")] == [30, 1, 120, 30, 45]
    assert requests.resolve_agent("MARA", {"mara": "Mara"}) == "Mara"
    assert requests.resolve_agent(None, {}) is None


def test_globs_and_links(spark):
    given = ["/x/boot-1.jsonl", "/boot-/a.jsonl", "/x/a.jsonl.bak-2", "/x/compact-9.jsonl"]
    assert values(spark, given, paths.is_excluded) == [True, False, True, True]
    assert values(spark, ["/x/a1.txt", "/x/b1.txt"], lambda c: paths.is_excluded(c, ["[!b]?.txt"])) == [True, False]
    linked = ["[Discord g channel id:12] [message_id: 34] x", "[message_id: 34]", "none"]
    assert values(spark, linked, text.deep_link) == ["https://discord.com/channels/@me/12/34", None, None]


def test_entities_equal_the_standard_library(spark):
    rng = random.Random(7)
    names = ["amp", "lt;", "gt", "nbsp;", "notin;", "not", "notit;", "copy", "copyleft", "hearts;", "CounterClockwiseContourIntegral;", "bogus;", "AMP;", "ngE;", "acE;"]
    numbers = ["0", "13", "128", "159", "160", "65", "55296", "57343", "1114111", "1114112", "64976", "65534", "99999999999999999999999", "00065", "1", "11", "127"]
    parts = [f"&{n}" for n in names] + [f"&#{n}" + e for n in numbers for e in ("", ";")] + [f"&#x{int(n):x};" for n in numbers] + [f"&#X{int(n):X}" for n in numbers]
    parts += ["&", "&&", "&#", "&#x;", "&;", " ", "x", ";", "é&", "\n", "&amp;lt;", "&a b", "&" + "z" * 40]
    given = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + parts + [None, ""]
    frame = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "id int, text string")
    found = {r.id: r.found for r in frame.select("id", text.decode_entities(F.col("text")).alias("found")).collect()}
    wrong = [(g, found[i], html.unescape(g)) for i, g in enumerate(given) if g is not None and found[i] != html.unescape(g)]
    assert not wrong and found[len(given) - 2] is None

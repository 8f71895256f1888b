"""Golden vectors, written for this repository."""

import hashlib
import hmac
import uuid
from urllib.parse import urljoin as py_urljoin

import pytest
from pyspark.sql import functions as F

from karvan.functions import ids
from karvan.functions import text as tx
from karvan.functions import titles
from karvan.operators import cdc

NORMAL = [
    ("كيك", "کیک"),
    ("لنت ترمز ۲۰۶ و ٤٠٥", "لنت ترمز 206 و 405"),
    ("مدرسة أحمد", "مدرسه احمد"),
    ("آینه", "آینه"),
    ("کـــروز", "کروز"),
    ("سَلام", "سلام"),
    ("قیمت ۱٬۲۰۰٫۵ تومان؟", "قیمت 1200.5 تومان?"),
    ("a — b − c", "a - b - c"),
    ("«اصل» “x” ‘y’", "\"اصل\" \"x\" 'y'"),
    ("⭐⭐ ویژه 🔥", "ویژه"),
    ("می‌رود ‌و", "می‌رود و"),
    ("می‌‌رود", "می‌رود"),
    ("a​b﻿c", "abc"),
    ("  a \t b\n", "a b"),
    ("ﻛﺘﺎب", "کتاب"),
    ("ＡＢＣ １２", "ABC 12"),
]
NUMBERS = [
    ("0k30e-14 302", "0K30E14302", True),
    ("۰K30E14302", "0K30E14302", True),
    ("لنت", "", False),
    ("12 34", "1234", False),
    ("ABCDEF", "ABCDEF", False),
    ("PN,12345", "PN12345", False),
    ("0451103318", "0451103318", True),
]
TITLES = [
    ("لنت ترمز 206 ارسال رایگان", "لنت ترمز 206"),
    ("فیلتر روغن 09121234567", "فیلتر روغن"),
    ("شمع NGK ۱۰۰ درصد اورجینال", "شمع NGK"),
    ("⭐⭐ تسمه تایم ⭐⭐", "تسمه تایم"),
    ("دیسک ترمز - www.shop.ir - ", "دیسک ترمز"),
    ("واتر پمپ (ارسال فوری)", "واتر پمپ"),
    ("فیلتر 0451103318 بوش", "فیلتر 0451103318 بوش"),
    ("قطعه اصل سایپا", "قطعه اصل سایپا"),
    ("تخفیف ویژه !!!", ""),
]


def one(spark, values, fn):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, v string").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def test_normalize_text(spark):
    assert one(spark, [a for a, _ in NORMAL], tx.normalize_text) == [b for _, b in NORMAL]


def test_normalize_is_idempotent(spark):
    once = [b for _, b in NORMAL]
    assert one(spark, once, tx.normalize_text) == once


def test_part_numbers(spark):
    values = [v for v, _, _ in NUMBERS]
    assert one(spark, values, tx.normalize_part_number) == [n for _, n, _ in NUMBERS]
    assert one(spark, values, tx.looks_like_part_number) == [ok for _, _, ok in NUMBERS]


def test_strip_promotional(spark):
    assert one(spark, [a for a, _ in TITLES], titles.strip_promotional) == [b for _, b in TITLES]
    dirty = one(spark, [a for a, _ in TITLES], titles.contains_promotional)
    assert dirty == [a != b for a, b in TITLES]


def test_phones_and_prices(spark):
    values = [
        "لنت 09121234567 جلو", "کد 09121234567 لنت", "450000 تومان شمع", "شماره فنی: 0242235666",
        "کد 123,456,789", "021-12345678 دیسک",
    ]
    want = ["لنت جلو", "کد 09121234567 لنت", "شمع", "شماره فنی: 0242235666", "کد 123,456,789", "دیسک"]
    assert one(spark, values, tx.strip_phones_prices) == want


def test_slug(spark):
    out = one(spark, ["  لنت ترمز (۲۰۶) ", "!!!", "a" * 60 + " " + "b" * 60], lambda c: titles.build_slug(c, F.lit("u1")))
    tail = hashlib.sha256(b"u1").hexdigest()[:6]
    assert out == [f"لنت-ترمز-206-{tail}", tail, "a" * 60 + "-" + tail]


def test_hashes(spark):
    name = "karvan:fitment-conflict:PN1:v1:1"
    got = one(spark, [name], ids.uuid5)[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    got = one(spark, ["10.0.0.1"], lambda c: ids.hmac_sha256("key", c))[0]
    assert got == hmac.new(b"key", b"10.0.0.1", hashlib.sha256).hexdigest()
    assert uuid.UUID(one(spark, ["x"], ids.uuid4_from)[0]).version == 4


@pytest.mark.parametrize("link", ["https://x.example/a", "//c.example/i.png", "/root/a", "b.html", "./b.html", "?q=1", "#top"])
def test_urljoin(spark, link):
    bases = ["https://a.example/x/y.html?p=1#f", "http://a.example", "https://a.example/dir/"]
    assert one(spark, bases, lambda c: tx.urljoin(c, F.lit(link))) == [py_urljoin(b, link) for b in bases]


def test_fragment_cap(spark):
    values = ["abc", "ééé", "x🔥🔥", "لنت ترمز"]
    for limit in range(1, 9):
        want = [v if len(v.encode()) <= limit else v.encode()[:limit].decode(errors="ignore") for v in values]
        assert one(spark, values, lambda c, n=limit: cdc.fragment_cap(c, n)) == want

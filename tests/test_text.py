"""Golden cases for names, models, attributes and fingerprints."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from pricetide.functions import attributes as A
from pricetide.functions import fingerprint as FP
from pricetide.functions import text as X

LOOSE = {
    "Intel Core i9-13900K 3.0GHz 24-Core Processor": "intel i9-13900k",
    "AMD Ryzen 7 7800X3D 8-Core AM5 CPU": "amd ryzen 7 7800x3d am5",
}
STRICT = {
    "Core i9-13900K Processor with Cooler": "core i9-13900k",
    "Ryzen 9 7950X3D Gaming CPU": "ryzen 9 7950x3d",
    "GeForce RTX 4070 Ti SUPER 16GB GDDR6X": "geforce rtx 4070 ti super 16",
}
BRANDS = {
    "ASUS ROG Strix GeForce RTX 4090 OC Edition 24GB GDDR6X": ("ASUS", "ROG Strix GeForce RTX 4090 OC Edition 24GB GDDR6X"),
    "Some Unknown Brand RTX 3080": (None, "Some Unknown Brand RTX 3080"),
    "be quiet! Dark Rock": ("be quiet!", "be quiet! Dark Rock"),
    "WD Black by Western Digital": ("Western Digital", "WD Black by"),
    "msi card for MSI fans": ("MSI", "card for MSI fans"),
    "LG": ("LG", "LG"),
}
ATTRIBUTES = [
    ("Intel Core i7 LGA1700", "CPUs", {"socket": "LGA1700", "intel_series": "Core i7"}),
    ("AMD Ryzen 9 AM5", "CPUs", {"socket": "AM5", "amd_series": "Ryzen 9"}),
    ("RTX 4070 12GB", "Graphics Cards", {"series": "RTX", "vram_gb": "12"}),
    ("Board B760M mATX LGA1700", "Motherboards", {"socket": "LGA1700", "form_factor": "ATX", "intel_chipset": "B760"}),
    ("X670E E-ATX AM5", "Motherboards", {"socket": "AM5", "form_factor": "E-ATX", "amd_chipset": "X670E"}),
    ("32GB DDR5 6000MHz SODIMM non-ECC", "Memory (RAM)",
     {"type": "DDR5", "capacity_gb": "32", "speed_mhz": "6000", "form_factor": "SODIMM", "ecc": "Non-ECC"}),
    ("990 Pro 2TB M.2 NVMe", "Storage (SSD/HDD)", {"type": "NVMe SSD", "capacity_gb": "2000", "form_factor": "M.2"}),
    ('Drive 8TB 3.5" HDD', "Storage (SSD/HDD)", {"type": "HDD", "capacity_gb": "8000", "form_factor": '3.5"'}),
    ("RM850x 850W 80 Plus Gold Fully Modular", "Power Supplies", {"wattage": "850", "rating": "80+ Gold", "modularity": "Fully Modular"}),
    ("850W Platinum", "PSU", {"wattage": "850", "rating": "80+ Platinum"}),
    ("Mid Tower Case", "PC Cases", {"size": "Mid Tower"}),
    ("AIO 360", "Cooling", {"type": "Liquid Cooler"}), ("Air Cooler", "Cooling", {"type": "Air Cooler"}),
    ('27" 1440p OLED 240Hz', "Monitors", {"screen_size_inch": "27.0", "resolution": "1440p", "panel_type": "OLED", "refresh_rate_hz": "240"}),
    ("Fan", "CPU Coolers", {}), ("Fan", "Fans & Accessories", {}),
]


def test_normalizers(spark):
    df = spark.createDataFrame([(k,) for k in [*LOOSE, *STRICT]], "s string")
    for r in df.select("s", X.normalize_loose(F.col("s")).alias("l"), X.normalize_strict(F.col("s")).alias("t")).collect():
        assert r.l == LOOSE.get(r.s, r.l) and r.t == STRICT.get(r.s, r.t)


def test_brand_and_model(spark):
    df = spark.createDataFrame([(k,) for k in BRANDS], "s string").withColumn("b", X.brand(F.col("s")))
    got = {r.s: (r.b, r.m) for r in df.withColumn("m", X.model(F.col("s"), F.col("b"))).collect()}
    assert got == BRANDS


def test_attributes(spark):
    df = spark.createDataFrame([(n, c) for n, c, _ in ATTRIBUTES], "n string, c string")
    got = [r.a for r in df.select(A.attributes(F.col("n"), F.col("c")).alias("a")).collect()]
    assert got == [want for _, _, want in ATTRIBUTES]


def test_fingerprint_text_forms(spark):
    cases = [
        (1, "Graphics Cards", "asus", "rtx 4070", {"series": "RTX", "vram_gb": "12"}, (1, "asus", "rtx 4070", (("series", "RTX"), ("vram_gb", 12)))),
        (7, "PC Cases", "", "evo", {"size": "Mid Tower"}, (7, "", "evo", (("size", "Mid Tower"),))),
        (5, "Storage (SSD/HDD)", "o'neil", "x", {"form_factor": '2.5"'}, (5, "o'neil", "x", (("form_factor", '2.5"'),))),
        (8, "Monitors", "lg", "m", {"screen_size_inch": "27.0"}, (8, "lg", "m", (("screen_size_inch", 27.0),))),
        (10, "Fans & Accessories", 'q"\\', "fan", {}, (10, 'q"\\', "fan", ())),
    ]
    df = spark.createDataFrame([c[:5] for c in cases], "i long, c string, b string, base string, a map<string,string>")
    text = FP.identity_text(F.col("i"), F.col("b"), F.col("base"), FP.attribute_pairs(F.col("c"), F.col("a")))
    for r, c in zip(df.select(text.alias("t"), X.short_hash(text).alias("h")).collect(), cases):
        assert r.t == repr(c[5]) and r.h == hashlib.sha1(repr(c[5]).encode()).hexdigest()[:24]


def test_price_text(spark):
    shown = {"$1,299.00": 1299.0, "POA": None, " 12 ": 12.0, "12d": None, "1_000": None, "": None, "1e3": 1000.0, ".5": 0.5}
    df = spark.createDataFrame([(k,) for k in shown], "s string")
    assert {r.s: r.p for r in df.select("s", X.price_from_text(F.col("s")).alias("p")).collect()} == shown


def test_words_and_mentions_as_plain_patterns_find_them(spark):
    """The boundary tested behind the letters, and the first mention cut with all that follows, against the plain forms."""
    words = ["OC", "(No Cooler)", "be quiet!", "Lian Li", "ASUS"]
    texts = ["oc OC, foc oć éOC OCé OC", "x(No Cooler)y (No Cooler) a(no cooler)b", "be quiet!x be quiet! Be Quiet!y", "Lian  Li\nLIAN LI\nlian li", "aſus ASUS\tASUS_ asuſ", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    for w in words:
        for flags in ("U", "iU"):
            plain = F.lit(f"(?{flags})\\b\\Q{w}\\E\\b")
            got = rows.select(F.regexp_replace("s", X._as_word(w, flags), F.lit("#")).alias("a"), F.regexp_replace("s", plain, F.lit("#")).alias("b"))
            assert all(r.a == r.b for r in got.collect()), (w, flags)
        first = F.regexp_replace("s", F.lit(rf"(?isU)^(.*?)\b\Q{w}\E\b"), F.lit("$1"))
        got = rows.select(F.regexp_replace("s", X._as_word(w, "isU", "(.*)"), F.lit("$1")).alias("a"), first.alias("b"))
        assert all(r.a == r.b for r in got.collect()), w


def test_a_text_is_worked_out_once_and_only_where_reached(spark, capsys):
    rows = spark.createDataFrame([("a",)], "s string")
    rows.select(X.nonempty(F.regexp_replace("s", "b+", "")).alias("t")).explain()
    assert capsys.readouterr().out.count("regexp_replace(") == 1
    forms = rows.withColumns({"loose": F.upper("s"), "strict": F.raise_error(F.col("s")).cast("string")})
    assert [r.t for r in forms.select(X.first_text(F.col("loose"), F.col("strict")).alias("t")).collect()] == ["A"]

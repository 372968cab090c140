"""Category attributes read from product names, as one native map expression per category.

Values are text; numbers keep the form they have in a fingerprint (``12``, ``27.0``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricetide.functions.text import nonempty


def _first(low: Column, rules: list[tuple[tuple[str, ...], str]]) -> Column:
    """Label of the first rule any of whose words occurs in the text."""
    picks = []
    for words, label in rules:
        seen = low.contains(words[0])
        for w in words[1:]:
            seen = seen | low.contains(w)
        picks.append(F.when(seen, label))
    return F.coalesce(*picks)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return nonempty(F.regexp_extract(text, pattern, group))


def _whole(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def _map(**values: Column) -> Column:
    flat = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())


# Words that decide an attribute, in order of precedence.
CPU_SOCKETS = [(("am5",), "AM5"), (("am4",), "AM4"), (("1700",), "LGA1700"), (("1200",), "LGA1200")]
INTEL_SERIES = [
    (("ultra 9",), "Core Ultra 9"), (("ultra 7",), "Core Ultra 7"), (("ultra 5",), "Core Ultra 5"),
    (("i9",), "Core i9"), (("i7",), "Core i7"), (("i5",), "Core i5"), (("i3",), "Core i3"),
]
AMD_SERIES = [
    (("ryzen 9",), "Ryzen 9"), (("ryzen 7",), "Ryzen 7"), (("ryzen 5",), "Ryzen 5"), (("ryzen 3",), "Ryzen 3"),
]
GPU_SERIES = [(("rtx",), "RTX"), (("gtx",), "GTX"), (("rx",), "RX"), (("arc",), "Arc")]
RESOLUTIONS = [(("4k", "2160p"), "4K"), (("1440p", "qhd"), "1440p"), (("1080p", "fhd"), "1080p")]
PANELS = [(("ips",), "IPS"), (("va",), "VA"), (("oled",), "OLED"), (("tn",), "TN")]
HDR_LEVELS = [
    (("hdr1000",), "HDR1000"), (("hdr600",), "HDR600"), (("hdr400",), "HDR400"),
    (("dolby vision",), "Dolby Vision"), (("hdr",), "HDR"),
]
BOARD_SOCKETS = [(("am5",), "AM5"), (("am4",), "AM4"), (("lga1700",), "LGA1700"), (("lga1200",), "LGA1200")]
RAM_TYPES = [(("ddr5",), "DDR5"), (("ddr4",), "DDR4")]
DISK_TYPES = [(("nvme",), "NVMe SSD"), (("ssd",), "SATA SSD"), (("hdd", "hard drive"), "HDD")]
DISK_FORMS = [(("m.2",), "M.2"), (("2.5",), '2.5"'), (("3.5",), '3.5"')]
MODULARITY = [
    (("fully modular",), "Fully Modular"), (("semi-modular", "semi modular"), "Semi-Modular"),
    (("non-modular", "non modular"), "Non-Modular"),
]
CASE_SIZES = [
    (("full tower",), "Full Tower"), (("mid tower",), "Mid Tower"), (("mini tower",), "Mini Tower"),
    (("sff", "small form factor"), "Small Form Factor"),
]
COOLER_TYPES = [(("liquid", "aio"), "Liquid Cooler"), (("air cooler", "tower"), "Air Cooler")]
PSU_80PLUS = r"\b(?:80\s*(?:\+|plus)|80plus)\s*(?:certified\s*)?"
PSU_TIERS = "titanium|platinum|gold|silver|bronze"
# Category router, in order: required words, word that must be absent, attribute family.
ROUTES = [
    (r"cpu", r"cooler", "cpu"),
    (r"graphics", None, "gpu"),
    (r"monitor", None, "monitor"),
    (r"motherboard", None, "board"),
    (r"memory|ram", None, "ram"),
    (r"storage|ssd|hdd", None, "disk"),
    (r"\bpower\s+suppl(?:y|ies)\b|\bpsu\b", None, "psu"),
    (r"case", None, "case"),
    (r"cooling", None, "cooler"),
]


def cpu(name: Column) -> Column:
    low = F.lower(name)
    socket = _first(low, CPU_SOCKETS)
    intel = low.contains("intel") | F.coalesce(socket.isin("LGA1700", "LGA1200"), F.lit(False))
    amd = low.contains("amd") | F.coalesce(socket.isin("AM5", "AM4"), F.lit(False))
    return _map(
        socket=socket,
        intel_series=F.when(intel, _first(low, INTEL_SERIES)),
        amd_series=F.when(amd, _first(low, AMD_SERIES)),
    )


def gpu(name: Column) -> Column:
    return _map(
        vram_gb=_whole(_found(name, r"(?iU)(\d+)\s*GB")), series=_first(F.lower(name), GPU_SERIES)
    )


def monitor(name: Column) -> Column:
    low = F.lower(name)
    return _map(
        screen_size_inch=_found(name, r'(?iU)(\d{2}(\.\d)?)\s*(inch|")').try_cast("double"),
        resolution=_first(low, RESOLUTIONS),
        panel_type=_first(low, PANELS),
        refresh_rate_hz=_whole(_found(low, r"(?U)(\d{2,3})\s*hz")),
        hdr_level=_first(low, HDR_LEVELS),
    )


def board(name: Column) -> Column:
    low = F.lower(name)
    socket = _first(low, BOARD_SOCKETS)
    intel_chip = F.upper(_found(name, r"(?iU)\b([ZBHXW]\d{3,4})"))
    amd_chip = F.upper(_found(name, r"(?iU)\b([XBA]\d{3}E?)\b"))
    amd_side = low.contains("amd") | F.coalesce(socket.isin("AM5", "AM4"), F.lit(False))
    intel_side = low.contains("intel") | F.coalesce(socket.isin("LGA1700", "LGA1200"), F.lit(False))
    form = (
        F.when(low.contains("e-atx") | low.contains("eatx"), "E-ATX")
        .when(low.contains("atx") & ~low.contains("micro-atx"), "ATX")
        .when(low.contains("micro-atx"), "Micro-ATX")
        .when(low.contains("mini-itx") | low.contains("mitx"), "Mini-ITX")
    )
    return _map(
        socket=socket,
        form_factor=form,
        amd_chipset=F.when(amd_side | (~intel_side & intel_chip.isNull()), amd_chip),
        intel_chipset=F.when(~amd_side, intel_chip),
    )


def ram(name: Column) -> Column:
    low = F.lower(name)
    return _map(
        type=_first(low, RAM_TYPES),
        capacity_gb=_whole(_found(name, r"(?iU)(\d+)\s*GB")),
        speed_mhz=_whole(_found(name, r"(?iU)(\d{4,})\s*MHz")),
        form_factor=F.when(low.contains("sodimm"), "SODIMM").otherwise("Desktop"),
        ecc=F.when(low.rlike(r"(?U)\b(?<!non-)ecc\b"), "ECC").otherwise("Non-ECC"),
    )


def disk(name: Column) -> Column:
    low = F.lower(name)
    sized = r"(?iU)(\d+(\.\d)?)\s*(TB|GB)"
    amount = _found(name, sized).try_cast("double")
    scale = F.when(F.upper(F.regexp_extract(name, sized, 3)) == "TB", 1000.0).otherwise(1.0)
    return _map(
        type=_first(low, DISK_TYPES),
        capacity_gb=(amount * scale).cast("long"),
        form_factor=_first(low, DISK_FORMS),
    )


def psu(name: Column) -> Column:
    low = F.lower(name)
    flat = F.regexp_replace(low, "[-_/]+", " ")
    rated = _found(flat, f"(?iU){PSU_80PLUS}({PSU_TIERS}|white|standard)\\b")
    bare = _found(flat, f"(?iU)\\b({PSU_TIERS})\\b")
    plain = F.when(flat.rlike(r"(?iU)\b(?:80\s*(?:\+|plus)|80plus)\b"), "white")
    tier = F.lower(F.coalesce(rated, bare, plain))
    label = F.initcap(F.when(tier == "standard", "white").otherwise(tier))
    return _map(
        wattage=_whole(_found(name, r"(?iU)(\d{3,4})W")),
        rating=F.concat(F.lit("80+ "), label),
        modularity=_first(low, MODULARITY),
    )


def case(name: Column) -> Column:
    return _map(size=_first(F.lower(name), CASE_SIZES))


def cooler(name: Column) -> Column:
    return _map(type=_first(F.lower(name), COOLER_TYPES))


EXTRACTORS = {
    "cpu": cpu, "gpu": gpu, "monitor": monitor, "board": board, "ram": ram, "disk": disk, "psu": psu,
    "case": case, "cooler": cooler,
}


def family(category_name: Column) -> Column:
    """Attribute family of a category, or null when the category has no attributes."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(category_name, F.lit(""))), "[^a-z0-9]+", " "))

    def route(t: Column) -> Column:
        picks = []
        for wanted, absent, label in ROUTES:
            hit = t.rlike(wanted)
            picks.append(F.when(hit & ~t.contains(absent) if absent else hit, label))
        return F.coalesce(*picks)

    return F.element_at(F.transform(F.array(text), route), 1)


def attributes(name: Column, category_name: Column) -> Column:
    """Attribute map of a product name under its category; empty without a known category.

    The one-element arrays bind the category text and the family, so each is worked out once per row.
    """

    def extract(which: Column) -> Column:
        out = None
        for label, extractor in EXTRACTORS.items():
            values = extractor(name)
            out = F.when(which == label, values) if out is None else out.when(which == label, values)
        return out.otherwise(F.create_map().cast("map<string,string>"))

    return F.element_at(F.transform(F.array(family(category_name)), extract), 1)

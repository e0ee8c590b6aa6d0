"""Name, label and key expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters a file-safe class name keeps, and the fallback name.
SLUG_DROP = r"[^a-zA-Z0-9._-]+"
UNNAMED = "_unnamed"
LAYER_PREFIX = "bbox_"
# Fixed value: every character Unicode counts as white space when splitting text.
SPACE = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")

# Vocabulary of the electrical filter, by group.
ELECTRICAL_GROUPS = {
    "outlets": ["RECEPTACLE", "RECEPTABLE", "OUTLET", "DUPLEX", "QUADPLEX", "T-SLOT",
                "GROUND FAULT", "SWITCHED", "SINGLE USE", "SPECIAL USE", "_WP"],
    "switches": ["SWITCH", "GANG", "SINGLE POLE", "THREE WAY", "FOUR WAY", "3 WAY", "DIMMER",
                 "OCCUPANCY SENSOR", "KEYED", "LOW VOLTAGE", "LV", "LINE VOLTAGE", "T-SWITCH",
                 "PUSH BUTTON", "PUSHBUTTON", "DISCONNECT", "TRANSFER SWITCH", "TAMPER",
                 "FLOW SWITCH", "SWITCH BANK"],
    "lighting": ["LIGHT", "LIGHTING", "FIXTURE", "LUMINAIRE", "DOWNLIGHT", "RECESSED", "SURFACE",
                 "SUSPENDED", "WALL MOUNTED", "CEILING MOUNTED", "PENDANT", "TRACK", "STRIP",
                 "LINEAR", "LED", "FLUORESCENT", "EMERGENCY LIGHT", "EXIT SIGN", "BATTERY PACK",
                 "REMOTE HEAD"],
    "panels": ["PANEL", "SUITE PANEL", "LIGHTING CONTROL PANEL", "CIRCUIT BREAKER", "MS", "MSA",
               "MSB", "MPP", "ATS", "DISTRIBUTION", "TRANSFORMER", "KVA", "KAIC", "SPD",
               "208Y/120V", "600Y/347V", "120/208V", "3PH", "1P", "3P"],
    "wiring": ["WIRING_DEVICESLEGEND", "WIRING_DEVICESSCHEDULE", "WIRING_ROUTINGLEGEND"],
    "conduit": ["CONDUIT", "CONDUIT CONTINUATION", "CONDUIT CONCEALED", "CONDUIT - UP",
                "CONDUIT - DOWN", "CONDUIT STUB", "UNDERGROUND"],
    "motors": ["MOTOR", "MECHANICAL MOTOR"],
    "generators": ["GENERATOR", "GENSET", "BACKUP GENERATOR", "KW"],
    "meters": ["METER", "UTILITY METER", "CURRENT TRANSFORMER", "POTENTIAL TRANSFORMER"],
    "ev_charging": ["PEV", "PEVA", "PEVB"],
    "fire_alarm": ["FIRE ALARM", "PULL STATION", "PULLSTATION", "SMOKE DETECTOR",
                   "CARBON MONOXIDE", "STROBE", "HORN", "SPEAKER", "MINI HORN", "BELL", "CM",
                   "MM", "IM", "AD", "FP", "END OF LINE RESISTOR", "15CD", "60CD"],
    "data_lowv": ["DATA OUTLET", "TELECOM", "NETWORK SWITCH", "CARD READER", "INTERCOM",
                  "SURVEILLANCE", "DOOR SECURITY MONITOR", "ELECTRIC STRIKE", "MAGNETIC LOCK",
                  "ELECTRIC HINGE", "MOTION SENSOR", "OCCUPANCY SENSOR", "THERMOSTAT",
                  "PHOTOELECTRIC", "DAYLIGHT", "POWER PACK", "0-10V", "NLIGHT"],
}


def electrical_vocabulary() -> Column:
    """Distinct lower-case union of all groups as one literal array."""
    groups = [F.array(*[F.lit(t) for t in g]) for g in ELECTRICAL_GROUPS.values()]
    return F.transform(F.array_distinct(F.flatten(F.array(*groups))), F.lower)


def electrical_terms() -> list[str]:
    """The same union as a sorted list."""
    return sorted({t.lower() for g in ELECTRICAL_GROUPS.values() for t in g})


def term_counts(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows (term, n): how many texts hold each lower-case term, without those that none holds.

    Terms are picked inside the row, so no text is copied per term and each is lower-cased once."""
    lower = rows.select(F.explode(F.array(F.lower(F.col(text)))).alias("_t"))  # a generator keeps it a column of its own
    held = F.filter(F.array(*[F.lit(w) for w in terms]), lambda w: F.contains(F.col("_t"), w))
    return lower.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def minimal_terms() -> list[str]:
    """Lower-case terms that contain no other term: any hit implies a hit of one of these."""
    terms = electrical_terms()
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def is_electrical(name: Column) -> Column:
    """True when any vocabulary term occurs in the name, ignoring case."""
    low = F.lower(F.coalesce(name, F.lit("")))
    hit = F.lit(False)
    for t in minimal_terms():
        hit = hit | low.contains(t)
    return hit


def is_wiring(category: Column) -> Column:
    return F.lower(F.coalesce(category, F.lit(""))).contains("wiring")


def strip(c: Column) -> Column:
    """Trim white space of every kind on both ends."""
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; none on the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def slugify(name: Column, max_len: int = 80) -> Column:
    s = F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), SLUG_DROP, "_"), F.lit("_"))
    return F.when(s == "", F.lit(UNNAMED)).otherwise(F.substring(s, 1, max_len))


def label_from_layer(layer: Column) -> Column:
    """Layer name without its prefix; empty becomes the fallback name."""
    n = strip(F.regexp_replace(strip(F.coalesce(layer, F.lit(""))), f"^{LAYER_PREFIX}", ""))
    return F.when(n == "", F.lit(UNNAMED)).otherwise(n)


def fingerprint(*fields: Column, length: int = 20) -> Column:
    """Key of a parameter set: fields joined by bars, SHA-1, leading hex digits."""
    return F.substring(F.sha1(F.concat_ws("|", *[f.cast("string") for f in fields])), 1, length)


def url_key(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


def resolve_path(base: Column, path: Column) -> Column:
    """Absolute paths stay, others hang below ``base``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))


def draw_key(seed: int, *ids: Column) -> Column:
    """Portable pseudo-random key: the same on every engine and every run."""
    parts = [F.lit(str(seed))] + [i.cast("string") for i in ids]
    return F.md5(F.concat_ws("|", *parts))

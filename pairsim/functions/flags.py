"""Run-flag strings (O91): parse ``KEY=VALUE`` tokens, fill defaults, canonical text, preset name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known keys with their defaults, in print order.
DEFAULTS = [
    ("TECHNIQUE", "baseline"),
    ("ALIGNMENT", "nw"),
    ("MH_ACROSS", "true"),
    ("F3M_ROWS", "2"),
    ("F3M_BANDS", "100"),
    ("F3M_RANKDIST", "1.0"),
    ("F3M_ADAPT_BANDS", "false"),
    ("F3M_ADAPT_THR", "false"),
    ("BUCKET_SIZE_CAP", "100"),
    ("MATCHER_REPORT", "false"),
    ("REPORT", "false"),
    ("PredictAlignment", "false"),
]

# Named presets (technique name -> non-default flags).
PRESETS = [
    ("baseline", {"TECHNIQUE": "baseline"}),
    ("f3m-nw", {"TECHNIQUE": "f3m", "ALIGNMENT": "nw"}),
    ("f3m-predict-dotprod-nw", {"TECHNIQUE": "f3m-predict-dotprod", "ALIGNMENT": "nw", "PredictAlignment": "true"}),
    ("f3m-predict-attention-nw", {"TECHNIQUE": "f3m-predict-attention", "ALIGNMENT": "nw", "PredictAlignment": "true"}),
    ("f3m-pa", {"TECHNIQUE": "f3m", "ALIGNMENT": "pa"}),
    ("f3m-predict-dotprod-pa", {"TECHNIQUE": "f3m-predict-dotprod", "ALIGNMENT": "pa", "PredictAlignment": "true"}),
    ("f3m-predict-attention-pa", {"TECHNIQUE": "f3m-predict-attention", "ALIGNMENT": "pa", "PredictAlignment": "true"}),
]


def parse(s: Column) -> Column:
    """The flag string as a map; of a repeated key the last value counts."""
    toks = F.filter(F.split(s, r"\s+"), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(toks, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def value_of(s: Column, key: str, default: str) -> Column:
    """Value of ``key`` in the flag string (last occurrence wins), else the default."""
    return F.coalesce(F.try_element_at(parse(s), F.lit(key)), F.lit(default))


def canonical(s: Column) -> Column:
    """Canonical flag text: equal after filling defaults <=> equal canonical text. Unknown keys are ignored."""
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(d).alias("d")) for k, d in DEFAULTS])

    def shown(given: Column) -> Column:
        filled = F.transform(known, lambda x: F.struct(x["k"].alias("k"), x["d"].alias("d"), F.coalesce(F.try_element_at(given, x["k"]), x["d"]).alias("v")))
        kept = F.filter(filled, lambda x: (x["v"] != x["d"]) | (x["k"] == known[0]["k"]))
        return F.array_join(F.transform(kept, lambda x: F.concat_ws("=", x["k"], x["v"])), " ")

    # The string is parsed once: the map is bound to a lambda variable.
    return F.element_at(F.transform(F.array(parse(s)), shown), 1)

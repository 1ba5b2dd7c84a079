"""Names, keywords and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from filigree.functions.stats import col


def by_keywords(text: Column | str, rules: Sequence[tuple[Sequence[str], str]], otherwise: str = "NA") -> Column:
    """The label of the first rule of which the lower-cased text contains all keywords."""
    low, out = F.lower(col(text)), None
    for words, label in rules:
        test = F.lit(True)
        for w in words:
            test = test & F.contains(low, F.lit(w.lower()))
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


#: The rules by which image names tell conditions, in order, by the name of the set.
CONDITIONS: dict[str, list[tuple[tuple[str, ...], str]]] = {
    "two conditions": [(("static",), "static"), (("resevoir",), "resevoir"), (("reservoir",), "resevoir"), (("flow",), "flow")],
    "valves": [
        (("static",), "static"), (("resevoir",), "resevoir"), (("reservoir",), "resevoir"),
        (("valve 1",), "high_flow"), (("valve 2",), "high_flow"), (("valve 7",), "high_flow"), (("valve 8",), "high_flow"),
        (("valve 3",), "low_flow"), (("valve 4",), "low_flow"), (("valve 5",), "low_flow"), (("valve 6",), "low_flow"),
    ],
    "media": [(("_ws_",), "WS"), (("_wp_",), "WP"), (("_ww_",), "WW")],
    "donors": [(("iris",), "iris"), (("poppy",), "poppy"), (("tulip",), "tulip"), (("bloom",), "bloom"), (("rose",), "rose"), (("daisy",), "daisy")],
    "sex of donors": [(("bloom",), "female"), (("poppy",), "female"), (("rose",), "female"), (("iris",), "male"), (("daisy",), "male"), (("tulip",), "male")],
    "batches": [(("270325.2",), "vehicle"), (("270325",), "dexa")],
}


def condition(name: Column | str, rules: str) -> Column:
    """The condition of an image by one of the sets of rules; NA where none applies."""
    return by_keywords(name, CONDITIONS[rules])


def short_number(value: Column | str) -> Column:
    """Four significant digits as text, halves away from 0; NA for what isn't a finite number."""
    x = col(value).try_cast("double")
    size = F.floor(F.log10(F.abs(x))).cast("int")
    plain = F.when(x == 0, "0").when(size.between(-4, 3), F.regexp_replace(F.format_string("%.8f", F.round(x * F.pow(F.lit(10.0), 3 - size)) / F.pow(F.lit(10.0), 3 - size)), r"\.?0+$", ""))
    scientific = F.regexp_replace(F.format_string("%.3e", x), r"\.?0+e", "e")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "NA").otherwise(F.coalesce(plain, scientific))


def mask_mode(file: Column | str, image: Column | str, forced: Column | None = None, is_forced: Column | None = None) -> Column:
    """light, dark or NULL (no mask) by keywords of the names; a forced value wins, also a forced NULL."""
    own = by_keywords(F.concat_ws(" ", col(file), col(image)), [(("marina", "bead"), "light"), (("marina",), "dark")], "")
    own = F.nullif(own, F.lit(""))
    return own if forced is None else F.when(is_forced if is_forced is not None else forced.isNotNull(), forced).otherwise(own)


def output_name(path: Column | str, image: Column | str, index: Column | str) -> Column:
    """Of an image in a container: stem, image name and number; else the stem."""
    p = col(path)
    stem = F.regexp_extract(p, r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    return F.when(F.lower(p).endswith(".lif"), F.concat(stem, F.lit("_"), F.regexp_replace(col(image), r"[/\\]", "_"), F.lit("_img"), col(index).cast("string"))).otherwise(stem)


def z_key(key: Column | str) -> Column:
    """The number in keys such as 12, "12" or "z12"; NULL for others."""
    return F.regexp_replace(F.lower(F.trim(col(key).cast("string"))), "^z", "").try_cast("int")


def voxel_size(z: Column, y: Column, x: Column) -> Column:
    """Sizes in micrometres that are finite and above 0; y and x stand in for each other."""
    good = lambda c: F.when((c > 0) & ~F.isnan(c) & (c < float("inf")), c)
    y, x = good(y), good(x)
    y, x = F.coalesce(y, x), F.coalesce(x, y)
    return F.struct(good(z).alias("z_um"), y.alias("y_um"), x.alias("x_um"), ((x + y) / 2).alias("xy_um"))


def microns_to_pixels(length: Column | str, step: Column | str) -> Column:
    return F.when((col(length) > 0) & (col(step) > 0), F.try_divide(col(length), col(step)))


def spacing(description: Column | str) -> Column:
    return F.regexp_extract(col(description), r"spacing=([0-9.eE+-]+)", 1).try_cast("double")


def significance(p: Column | str) -> Column:
    """-log10 of p, which counts as 1e-300 at least; NULL for none."""
    return F.when(col(p).isNotNull(), -F.log10(F.greatest(col(p), F.lit(1e-300))))

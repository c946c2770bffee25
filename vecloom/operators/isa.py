"""Instruction-mix summaries of rows (wheel, object, mnemonic, op_str), and CPU identification registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Instruction families by mnemonic.
FAMILIES = {
    "dotprod": ["sdot", "udot"],
    "i8mm": ["smmla", "ummla", "usmmla", "usdot", "sudot"],
    "bf16": ["bfmmla", "bfdot", "bfcvt", "bfcvtn", "bfcvtn2", "bfmlalb", "bfmlalt"],
    "fp16": ["fmlal", "fmlal2", "fmlsl", "fmlsl2"],
    "sme": ["smstart", "smstop", "zero", "addha", "addva", "mova", "ld1rob", "st1w"],
}
IMPLEMENTERS = {0x41: "Arm Limited", 0x42: "Broadcom", 0x43: "Cavium/Marvell", 0x46: "Fujitsu", 0x48: "HiSilicon", 0x4E: "NVIDIA", 0x50: "Ampere", 0x51: "Qualcomm", 0x61: "Apple", 0x6D: "Microsoft"}
PARTS = {
    0xD03: "Cortex-A53", 0xD05: "Cortex-A55", 0xD07: "Cortex-A57", 0xD08: "Cortex-A72", 0xD09: "Cortex-A73", 0xD0A: "Cortex-A75", 0xD0B: "Cortex-A76",
    0xD0C: "Neoverse-N1", 0xD0D: "Cortex-A77", 0xD40: "Neoverse-V1", 0xD41: "Cortex-A78", 0xD44: "Cortex-X1", 0xD47: "Cortex-A710", 0xD48: "Cortex-X2",
    0xD49: "Neoverse-N2", 0xD4C: "Cortex-X1C", 0xD4D: "Cortex-A715", 0xD4E: "Cortex-X3", 0xD4F: "Neoverse-V2", 0xD84: "Neoverse-V3", 0xD8E: "Neoverse-N3",
}
# End of fixed values.


def normalize(mnemonic: Column) -> Column:
    return F.element_at(F.split(F.lower(mnemonic), "\\."), 1)


def is_sme(mnemonic: Column, ops: Column) -> Column:
    o = F.lower(F.coalesce(ops, F.lit("")))
    return F.lower(mnemonic).isin("smstart", "smstop") | o.contains("za") | o.contains("zt0")


def is_sve(ops: Column) -> Column:
    """Whether a z or p register (0 to 31) is an operand."""
    return F.lower(F.coalesce(ops, F.lit(""))).rlike("(?:^|[{},\\s])[zp]0*(?:[12]?[0-9]|3[01])(?:[./][^{},\\s]*)?(?:$|[{},\\s])")


def feature_counts(df: DataFrame) -> DataFrame:
    """(feature, hits). A mnemonic of the sme family counts only where it uses that family's registers, and then twice; sve is
    not tried where those registers are used: as the published reports count them."""
    m, sme = normalize(F.col("mnemonic")), is_sme(F.col("mnemonic"), F.col("op_str"))
    family = [F.when(m.isin(*names) & (sme if f == "sme" else F.lit(True)), F.lit(f)) for f, names in FAMILIES.items()]
    marks = [*family, F.when(sme, F.lit("sme")), F.when(~sme & is_sve(F.col("op_str")), F.lit("sve"))]
    return df.select(F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("hits"))


def top_mnemonics(df: DataFrame, n: int = 15) -> DataFrame:
    return df.groupBy(normalize(F.col("mnemonic")).alias("mnemonic")).count().orderBy(F.col("count").desc(), "mnemonic").limit(n)


def midr_fields(midr: Column) -> tuple[Column, Column]:
    """(implementer, part) of a MIDR value."""
    return F.shiftright(midr, 24).bitwiseAND(0xFF), F.shiftright(midr, 4).bitwiseAND(0xFFF)


def kernels_per_core(symbols: DataFrame, pattern: str) -> DataFrame:
    """(symbol) -> per core (group 1 of pattern) the number of kernels and the first three names of matrix kernels."""
    s = symbols.withColumn("core", F.regexp_extract("symbol", pattern, 1)).where("core <> ''")
    gemm = F.when(F.col("symbol").contains("gemm_kernel"), F.col("symbol"))
    return s.groupBy("core").agg(F.count(F.lit(1)).alias("kernels"), F.slice(F.sort_array(F.collect_set(gemm)), 1, 3).alias("gemm"))


def named(code: Column, names: dict) -> Column:
    """The name of a code, or 'unknown'."""
    known = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return F.coalesce(F.element_at(known, code.cast("int")), F.lit("unknown"))


def cpu_facts(lines: DataFrame) -> DataFrame:
    """Lines of a processor description, (host, line), with 'Features : ...' and 'midr: 0x...' -> one row per host: its
    implementer, part and their names, and its features in order. Hosts without either line have nulls and no features."""
    low = F.lower(F.trim("line"))
    value = F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    midr = F.when(low.startswith("midr"), F.conv(F.regexp_replace(value, "^0[xX]", ""), 16, 10).cast("long"))
    found = F.when(low.startswith("features"), F.split(value, "\\s+"))
    one = lines.groupBy("host").agg(F.max(midr).alias("midr"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(found)))).alias("features"))  # a host's lines are few
    i, p = midr_fields(F.col("midr"))
    name = lambda c, names: F.when(F.col("midr").isNotNull(), named(c, names))
    return one.select("host", i.alias("implementer"), name(i, IMPLEMENTERS).alias("implementer_name"), p.alias("part"), name(p, PARTS).alias("part_name"), F.filter("features", lambda x: x != "").alias("features"))


def coverage(df: DataFrame, words: DataFrame) -> DataFrame:
    """Instructions (wheel, object) and code words (wheel, object, code_words) -> per object the share of words that were
    decoded: a count of zero can be trusted only where that is near 1. 0 where an object has no code."""
    n = df.groupBy("wheel", "object").agg(F.count(F.lit(1)).alias("instructions"))
    out = words.join(n, ["wheel", "object"], "left").withColumn("instructions", F.coalesce("instructions", F.lit(0).cast("long")))
    return out.select("wheel", "object", "instructions", "code_words", F.when(F.col("code_words") > 0, F.round(F.col("instructions") / F.col("code_words"), 4)).otherwise(0.0).alias("coverage"))

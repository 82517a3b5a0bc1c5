"""Cost formulas (COST-2, COST-6..16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bandwidths in GB/s, prefill tokens/s, GPU access seconds, bytes of one document's block.
BENCH = {"nvme_gbps": 6.0, "pcie_gbps": 128.0, "prefill": 5000.0}
GPU_ACCESS = 1e-5
BLOCK_BYTES = 1200 * 576 * 61 * 2 * 5
#: Serverless memory tiers in MB, with their price.
MEMORY_TIERS = {
    128: 0.0000000017,
    512: 0.0000000067,
    1024: 0.0000000133,
    1536: 0.0000000200,
    2048: 0.0000000267,
    3072: 0.0000000400,
    4096: 0.0000000533,
    5120: 0.0000000667,
    6144: 0.0000000800,
    7168: 0.0000000933,
    8192: 0.0000001067,
    9216: 0.0000001200,
    10240: 0.0000001333,
}
#: MB/s of an object store's reads by kind; its prices per request and per GB.
READ_MBPS = {"standard": 40.0, "transfer_acceleration": 200.0, "express_one_zone": 80 * 1024.0}
WRITE_PRICE, READ_PRICE = (0.0000005, 0.000005), (0.0000004, 0.0000004)
#: Price per GB-second up to 6e9, up to 15e9, and beyond; price of a million requests.
DURATION_PRICE, REQUEST_PRICE = (0.0000166667, 0.000015, 0.0000133334), 0.20


def tier_cost(size: Column, tier: Column, k: Column, length: int = 1200, bench: dict = BENCH) -> Column:
    """Seconds to serve a query of k documents from a node of ``size`` stored in ``tier``."""
    rest = F.greatest(F.lit(0), k - size) * length / bench["prefill"]
    gb = size * float(BLOCK_BYTES) / float(1024**3)
    pcie, nvme = gb / bench["pcie_gbps"], gb / bench["nvme_gbps"]
    return F.when(tier == "gpu", GPU_ACCESS + rest).when(tier == "dram", pcie + rest).when(tier == "disk", nvme + pcie + rest).otherwise(k * length / bench["prefill"])


def placement_rule(size: Column, gpu: int = 3, dram: int = 7) -> Column:
    """Tier by size; the second version of the rule has limits 8 and 9."""
    return F.when(size <= gpu, F.lit("GPU")).when(size <= dram, F.lit("DRAM")).otherwise(F.lit("DISK"))


def path_cost(size: Column, seq_length: Column, placement: Column, k: Column, bench: dict = BENCH) -> Column:
    """Access time of a node on a path, remainder not clamped (COST-6); null for an empty node."""
    per = F.try_divide(seq_length, size)
    compute = (k - size) * per / bench["prefill"]
    load = F.when(placement == "GPU", F.lit(0.0)).when(placement == "DRAM", size / bench["pcie_gbps"]).when(placement == "DISK", size / bench["nvme_gbps"] + size / bench["pcie_gbps"])
    return load + compute


def lambda_memory(mb: Column) -> Column:
    """The smallest tier that holds mb; null above the largest."""
    return F.array_min(F.filter(F.array(*[F.lit(t) for t in MEMORY_TIERS]), lambda t: t >= mb))


def lambda_price(tier: Column) -> Column:
    return F.create_map(*[x for t, p in MEMORY_TIERS.items() for x in (F.lit(t), F.lit(p))])[tier]


def s3_write(mb: Column) -> Column:
    return WRITE_PRICE[0] + WRITE_PRICE[1] * mb / 1024


def s3_read(mb: Column) -> Column:
    return READ_PRICE[0] + READ_PRICE[1] * mb / 1024


def duration_cost(seconds: Column, mb: Column) -> Column:
    """Marginal price over three bands of GB-seconds."""
    g = seconds * mb / 1024
    a, b = 6e9, 15e9
    p = DURATION_PRICE
    return F.when(g <= a, g * p[0]).when(g <= b, a * p[0] + (g - a) * p[1]).otherwise(a * p[0] + (b - a) * p[1] + (g - b) * p[2])


def request_cost(n: Column) -> Column:
    return n * REQUEST_PRICE / 1e6


def exec_seconds(instructions: Column) -> Column:
    return instructions / (6 * 2.8e9 * 8)


def read_seconds(mb: Column, kind: Column) -> Column:
    """Null for an unknown kind."""
    out = F.lit(None).cast("double")
    for k, v in READ_MBPS.items():
        out = F.when(kind == k, mb / v).otherwise(out)
    return out


def bucket_scan_seconds(bucket: Column, memory: Column, dim: Column) -> Column:
    """Compute and read time of a bucket times whole loads of the memory: 0 while the bucket fits (D10)."""
    vectors = F.floor(bucket / (dim * 4))
    return (exec_seconds(dim * vectors * 3) + bucket / READ_MBPS["standard"]) * F.floor(bucket / memory)


def knn_cost(n: Column, dim: Column, bucket: Column, memory: Column) -> Column:
    """Scans, each with its compute and its request; the units of the formula are kept as they are."""
    scans = n * (dim * 4) * 4 * 0.003 / bucket
    return scans * (duration_cost(bucket_scan_seconds(bucket, memory, dim), memory) + request_cost(F.lit(1)))

"""Can a host show 16-bit saturation of quantized products? Yes, no, or unknown."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Machine names per architecture.
X86 = ["x86_64", "amd64", "i386", "i686"]
ARM = ["arm64", "aarch64", "armv7l", "armv8l"]


def classify_host(machine: Column, flags: Column) -> Column:
    """struct<is_x86, is_arm, flags_readable, has_avx2, has_avx512, has_vnni,
    saturation_possible, reason, suitable>. An x86 host whose flags cannot be
    read is unknown (null), never "no"; only a certain yes is suitable."""
    machine = F.lower(machine)
    readable = F.coalesce(F.size(flags) > 0, F.lit(False))
    x86, arm = F.coalesce(machine.isin(X86), F.lit(False)), F.coalesce(machine.isin(ARM), F.lit(False))

    def has(needle: str) -> Column:
        return F.when(readable, F.exists(flags, lambda f: F.contains(F.lower(f), F.lit(needle))))

    avx2, avx512, vnni = has("avx2"), has("avx512"), has("vnni")
    possible = (F.when(arm | ~x86, F.lit(False))
                .when(~readable, F.lit(None).cast("boolean"))
                .when(vnni, F.lit(False))
                .otherwise(avx2 | avx512))
    reason = (F.when(arm, F.lit("Arm dot products accumulate in 32 bits, so nothing saturates"))
              .when(~x86, F.lit("neither x86 nor Arm, so the question does not apply"))
              .when(~readable, F.lit("x86, but the feature flags could not be read: unverified, not absent"))
              .when(vnni, F.lit("x86 with VNNI accumulates in 32 bits, so nothing saturates"))
              .when(avx2 | avx512, F.lit("x86 with AVX2 or AVX512 and no VNNI: 16-bit lanes can saturate"))
              .otherwise(F.lit("x86 without AVX2 or AVX512 does not take the 16-bit path")))
    return F.struct(x86.alias("is_x86"), arm.alias("is_arm"), readable.alias("flags_readable"),
                    avx2.alias("has_avx2"), avx512.alias("has_avx512"), vnni.alias("has_vnni"),
                    possible.alias("saturation_possible"), reason.alias("reason"),
                    F.coalesce(possible, F.lit(False)).alias("suitable"))

"""Decoding of the host's throttle bitfield.

Works on hexadecimal text digit by digit, so a reading wider than 64 bits is
decoded exactly instead of overflowing a bigint.
"""

from pyspark.sql import Column

from faultscope.functions.sql import let_sql, literal, within_let

# Documented bits. Live conditions, then "has occurred" records.
LIVE = {
    0: ("undervoltage", "undervoltage detected"),
    1: ("freq_capped", "Arm frequency capped"),
    2: ("throttled", "currently throttled"),
    3: ("soft_temp_limit", "soft temperature limit active"),
}
STICKY = {
    16: ("undervoltage_occurred", "undervoltage has occurred"),
    17: ("freq_capped_occurred", "Arm frequency capping has occurred"),
    18: ("throttled_occurred", "throttling has occurred"),
    19: ("soft_temp_limit_occurred", "soft temperature limit has occurred"),
}
DOCUMENTED = sorted({**LIVE, **STICKY})

_HALF = 1 << 60


def hex_of_decimal_sql(digits: str) -> str:
    """Hex text of up to 32 decimal digits."""
    number, half = f"cast({digits} as decimal(38,0))", f"cast({_HALF} as decimal(19,0))"
    low = f"cast({number} - h * {half} as bigint)"
    return within_let(f"cast({number} div {half} as decimal(19,0))", "h",
                      f"if(h = 0, hex({low}), concat(hex(cast(h as bigint)), lpad(hex({low}), 15, '0')))")


def _is_set(bit: str) -> str:
    return f"(shiftright(instr('0123456789ABCDEF', substr(h, length(h) - cast({bit} div 4 as int), 1)) - 1, {bit} % 4) & 1) = 1"


def _named(table: dict) -> str:
    entries = ", ".join(f"struct({bit} as bit, '{key}' as key)" for bit, (key, _) in table.items())
    return f"transform(filter(array({entries}), e -> e.bit < length(h) * 4 and {_is_set('e.bit')}), e -> e.key)"


def decode_sql(digits: str) -> str:
    """struct<hex, live, sticky, unknown_bits, healthy> of hexadecimal digits."""
    documented = ", ".join(map(str, DOCUMENTED))
    return within_let(
        f"coalesce(nullif(ltrim('0', upper({digits})), ''), '0')", "h",
        f"struct(concat('0x', h) as hex, {_named(LIVE)} as live, {_named(STICKY)} as sticky, "
        f"filter(sequence(0, length(h) * 4 - 1), b -> b not in ({documented}) and {_is_set('b')}) as unknown_bits, h = '0' as healthy)")


def describe_sql(keys: str) -> str:
    """Prose list of condition keys; an unknown key stands for itself."""
    prose = "map(" + ", ".join(f"{literal(k)}, {literal(p)}" for k, p in (*LIVE.values(), *STICKY.values())) + ")"
    return f"array_join(transform({keys}, k -> coalesce(try_element_at({prose}, k), k)), ', ')"


def decode_bitfield(value: Column) -> Column:
    """struct<raw, hex, live, sticky, unknown_bits, healthy> of a bigint; a negative
    value is refused (null)."""
    decoded = within_let(decode_sql("hex(v)"), "d",
                         "struct(v as raw, d.hex as hex, d.live as live, d.sticky as sticky, d.unknown_bits as unknown_bits, d.healthy as healthy)")
    return let_sql(value.cast("bigint"), "v", f"case when v >= 0 then {decoded} end")


def describe_bits(keys: Column) -> Column:
    return let_sql(keys, "ks", describe_sql("ks"))

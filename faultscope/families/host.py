"""Raspberry Pi host captures."""

from faultscope.families.base import Family, Field, Sql, line
from faultscope.functions.bits import decode_sql, describe_sql, hex_of_decimal_sql
from faultscope.functions.sql import within_let


def _listed(values: str, quote: str = '"') -> str:
    """JSON text of a list of plain words or numbers."""
    return f"if(size({values}) = 0, '[]', concat('[{quote}', array_join({values}, '{quote},{quote}'), '{quote}]'))"


def _map(**entries: str) -> str:
    return "map(" + ", ".join(f"'{key}', cast({value} as string)" for key, value in entries.items()) + ")"


def _named(keys: str) -> str:
    return _map(conditions=describe_sql(keys), condition_keys=_listed(keys), count=f"size({keys})", hex="d.hex")


# Decimal text of the reading. 31 and 32 hex digits may exceed 38 decimal ones: there the
# upper 64 bits are a = 10 * q + r, the number is 10 * (q * 2**64) + r * 2**64 + the rest.
_DIGITS = "substr(d.hex, 3)"
_TWO_64 = f"cast({1 << 64} as decimal(20,0))"
_LONG = within_let(
    f"struct(cast(conv(left({_DIGITS}, length({_DIGITS}) - 16), 16, 10) as decimal(20,0)) as a, cast(conv(right({_DIGITS}, 16), 16, 10) as decimal(20,0)) as b)", "n",
    within_let(f"cast((n.a % 10) * {_TWO_64} + n.b as decimal(22,0))", "m",
               f"concat(cast(cast(n.a div 10 as decimal(19,0)) * {_TWO_64} + cast((m - m % 10) / 10 as decimal(21,0)) as decimal(38,0)), cast(m % 10 as int))"))
_RAW = (f"case when {{2}} <> '' then cast(try_cast({{2}} as decimal(38,0)) as string) when length({_DIGITS}) <= 15 then cast(cast(conv({_DIGITS}, 16, 10) as decimal(38,0)) as string) "
        f"when length({_DIGITS}) <= 30 then cast(cast(conv(left({_DIGITS}, length({_DIGITS}) - 15), 16, 10) as decimal(19,0)) "
        f"* cast({1 << 60} as decimal(19,0)) + cast(conv(right({_DIGITS}, 15), 16, 10) as decimal(19,0)) as string) else {_LONG} end")
_WHOLE = "map_filter(" + _map(
    hex="d.hex", dec="nullif({2}, '')", raw=_RAW, live=_listed("d.live"), sticky=_listed("d.sticky"),
    unknown_bits=_listed("d.unknown_bits", ""), healthy="d.healthy") + ", (k, v) -> v is not null)"

# A reading and the states it stands for, in order: what holds now, what happened
# earlier, bits nobody documents, or nothing at all.
_STATES = (
    ("throttled_bitfield", "true", _WHOLE),
    ("throttle_active", "size(d.live) > 0", _named("d.live")),
    ("throttle_occurred", "size(d.sticky) > 0", _named("d.sticky")),
    ("throttle_unknown_bits", "size(d.unknown_bits) > 0",
     _map(bits="array_join(transform(d.unknown_bits, b -> cast(b as string)), ', ')", bit_numbers=_listed("d.unknown_bits", ""), hex="d.hex")),
    ("throttle_clear", "d.healthy", _map(hex="d.hex")),
)
_READING = within_let(
    decode_sql(f"if({{1}} <> '', {{1}}, {hex_of_decimal_sql('{2}')})"), "d",
    "array_compact(array(" + ", ".join(
        f"case when {cond} then struct({i} as ordinal, '{kind}' as kind, {data} as data) end"
        for i, (kind, cond, data) in enumerate(_STATES)) + "))")


_CELSIUS = Field("celsius", "coalesce(cast(try_cast({1} as double) as string), {1})")

# The tools' and the kernel's formats, in matching order.
# The key is required: a bare hexadecimal value is no reading.
SIGNATURES = (
    line("throttled_bitfield", "throttled<eq><bits>", expand=_READING),
    line("soc_temperature", "temp<eq><decimal>'C", _CELSIUS),
    line("soc_temperature", "temp<eq><decimal>C", _CELSIUS),
    line("arm_clock", "frequency(<int>)<eq><int>", Field("clock_id", 1), Field("hertz", "try_cast({2} as decimal(38,0))"), Field("mhz", "try_cast({2} as decimal(38,0)) div 1000000")),
    line("oom_kill", "Out of memory: Killed process <int> (<inner>)", Field("pid", 1), Field("process", 2)),
    line("oom_invoked", "<path> invoked oom-killer: gfp_mask=<word>,<text>order=<signed>", Field("invoker", 1), Field("gfp_mask", 2), Field("order", 4)),
    line("oom_memory_summary", "Mem-Info:"),
    line("oom_memory_summary", "Total swap = <int>kB", Field("total_swap", 1)),
    line("oom_memory_summary", "<int> pages RAM", Field("pages", 1)),
    line("allocation_failed", "Failed to allocate memory for requested buffer of size <int>", Field("bytes", "try_cast({1} as decimal(38,0))"),
         Field("mib", "round(try_cast({1} as double) / 1024 / 1024, 1)")),
    line("allocation_failed", "bad_alloc"),
)

SUMMARIES = {
    "throttled_bitfield": Sql("concat('get_throttled reads ', coalesce({dec}, {hex}))"),
    "throttle_active": "Now: {conditions}",
    "throttle_occurred": "Earlier: {conditions}",
    "throttle_unknown_bits": "Bits without documented meaning are set: {bits}",
    "throttle_clear": "No throttling and no undervoltage, now or earlier",
    "soc_temperature": "SoC temperature {celsius} °C",
    "arm_clock": "Arm clock {mhz} MHz",
    "oom_kill": "The kernel killed '{process}' (pid {pid}) for lack of memory",
    "oom_invoked": "'{invoker}' ran into the out-of-memory killer",
    "oom_memory_summary": "Memory state at the time of the kill",
    "allocation_failed": Sql("coalesce(concat('A buffer of ', {bytes}, ' bytes could not be allocated'), 'An allocation failed (bad_alloc)')"),
}

_DOCS = "https://www.raspberrypi.com/documentation/computers/os.html"
_MEMORY = "https://docs.kernel.org/admin-guide/mm/concepts.html"

RULES = [
    {"id": "ED0401", "severity": "error", "requires": ["throttle_active"],
     "optional": ["soc_temperature", "arm_clock"],
     "message": "the board is throttling at this moment ({conditions}), so timings taken now are void",
     "cause": "Power or heat limits the clock right now. Every latency measured in this state "
              "describes the power supply or the cooling, not the model.",
     "suggestions": [
         {"summary": "Use a stronger power supply and better cooling, then measure again"},
         {"summary": "Check the state again", "command": "vcgencmd get_throttled", "applicability": "machine-applicable"}],
     "refs": [_DOCS]},
    {"id": "ED0402", "severity": "warning", "requires": ["throttle_occurred"],
     "absent": ["throttle_active"], "optional": ["soc_temperature"],
     "message": "the board throttled since it was started ({conditions}), so earlier timings may be void",
     "cause": "The records stay set until a restart and do not say when it happened. A measurement "
              "from before this reading may have been taken in a limited state.",
     "suggestions": [
         {"summary": "Restart, then read the field before and after each timing run"},
         {"summary": "Repeat the measurements of this session"}],
     "refs": [_DOCS]},
    {"id": "ED0403", "severity": "error", "requires": ["oom_kill"],
     "optional": ["oom_invoked", "oom_memory_summary"],
     "message": "the kernel killed process '{process}' because memory ran out",
     "cause": "The process did not fail by itself, so there is no traceback. The model and its "
              "working memory did not fit beside the rest.",
     "suggestions": [
         {"summary": "Use a smaller batch or a smaller model"},
         {"summary": "Stop other processes or use a board with more memory"}],
     "refs": [_MEMORY]},
    {"id": "ED0404", "severity": "error", "requires": ["allocation_failed"],
     "absent": ["oom_kill"], "optional": ["oom_memory_summary"],
     "message": "a memory allocation failed: the runtime could not get the buffer it asked for",
     "cause": "The allocator gave up and the process lived on, unlike a kill by the kernel. The size "
              "in the evidence tells which tensor it may be.",
     "suggestions": [
         {"summary": "Lower the batch size or the input resolution"},
         {"summary": "Switch the memory arena off to lower the peak"}],
     "refs": [_MEMORY]},
    {"id": "ED0405", "severity": "warning", "requires": ["throttle_unknown_bits"],
     "message": "get_throttled has bits without documented meaning: {bits}",
     "cause": "The firmware reports something the documentation does not name. It is shown as it is "
              "rather than guessed at.",
     "suggestions": [{"summary": "Compare with the documentation of the installed firmware"}],
     "refs": [_DOCS]},
    {"id": "ED0406", "severity": "info", "requires": ["throttle_clear"],
     "absent": ["throttle_active", "throttle_occurred", "throttle_unknown_bits", "oom_kill"],
     "optional": ["soc_temperature", "arm_clock"],
     "message": "no throttling and no undervoltage, now or earlier: timings of this host hold",
     "cause": "All bits are clear, including those that record earlier events.",
     "suggestions": [{"summary": "Keep the reading with the measurements"}],
     "refs": [_DOCS]},
]

FAMILY = Family("raspberrypi", SIGNATURES, SUMMARIES, rules=RULES)

"""One module of data per artifact family; adding a family adds data, not engine code."""

from faultscope.families import host, ort, poly, trt

FAMILIES = {f.name: f for f in (trt.FAMILY, poly.FAMILY, ort.FAMILY, host.FAMILY)}

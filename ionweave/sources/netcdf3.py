"""NetCDF-3 classic files (CDF-1 and CDF-2): a reader of ranges and a small writer.

The format is public: a big-endian header of dimensions, attributes and variables, then the data.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CODES = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    attrs: dict
    dtype: str
    begin: int
    record: bool


@dataclass(frozen=True)
class Header:
    dims: dict[str, int]
    attrs: dict
    variables: dict[str, Variable]
    n_records: int
    record_size: int


class _Reader:
    def __init__(self, f: BinaryIO, wide: bool) -> None:
        self.f, self.wide = f, wide

    def i4(self) -> int:
        return struct.unpack(">i", self.f.read(4))[0]

    def name(self) -> str:
        n = self.i4()
        out = self.f.read(n).decode()
        self.f.read(-n % 4)
        return out

    def values(self, kind: int, n: int):
        dtype = np.dtype(TYPES[kind])
        raw = self.f.read(n * dtype.itemsize)
        self.f.read(-len(raw) % 4)
        if kind == 2:
            return raw.rstrip(b"\0").decode("latin-1")
        v = np.frombuffer(raw, dtype)
        return v[0].item() if n == 1 else v

    def attrs(self) -> dict:
        tag, n = self.i4(), self.i4()
        assert tag in (0, 12), "not a list of attributes"
        out = {}
        for _ in range(n):
            name = self.name()
            out[name] = self.values(self.i4(), self.i4())
        return out


def read_header(f: BinaryIO) -> Header:
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a NetCDF classic file")
    r = _Reader(f, magic[3] == 2)
    n_records = r.i4()
    tag, n = r.i4(), r.i4()
    dims, free = {}, None
    for _ in range(n):
        name, size = r.name(), r.i4()
        dims[name] = size
        free = name if size == 0 else free
    attrs = r.attrs()
    tag, n = r.i4(), r.i4()
    names, out, record_size = list(dims), {}, 0
    for _ in range(n if tag == 11 else 0):
        name = r.name()
        ids = [r.i4() for _ in range(r.i4())]
        a, kind, size = r.attrs(), r.i4(), r.i4()
        begin = struct.unpack(">q", f.read(8))[0] if r.wide else r.i4()
        record = bool(ids) and names[ids[0]] == free
        record_size += size if record else 0
        out[name] = Variable(name, tuple(names[i] for i in ids), a, TYPES[kind], begin, record)
    if free is not None:
        dims[free] = n_records
    return Header(dims, attrs, out, n_records, record_size)


def read_variable(f: BinaryIO, h: Header, name: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values ``start`` to ``stop`` of a one-dimensional variable, in native byte order."""
    v = h.variables[name]
    n = h.dims[v.dims[0]] if v.dims else 1
    stop = n if stop is None else min(stop, n)
    dtype = np.dtype(v.dtype)
    if v.record and h.record_size != dtype.itemsize:  # records of several variables take turns
        out = np.empty(max(0, stop - start), dtype)
        for k in range(start, stop):
            f.seek(v.begin + k * h.record_size)
            out[k - start] = np.frombuffer(f.read(dtype.itemsize), dtype)[0]
    else:
        f.seek(v.begin + start * dtype.itemsize)
        out = np.frombuffer(f.read(max(0, stop - start) * dtype.itemsize), dtype)
    return out.astype(dtype.newbyteorder("="))


def write(path: str, variables: dict[str, tuple[str, np.ndarray]], attrs: dict[str, str | float | int]) -> None:
    """A CDF-1 file of one-dimensional variables: name -> (dimension, values)."""
    dims: dict[str, int] = {}
    for dim, v in variables.values():
        dims[dim] = len(v)
    i4 = lambda *x: struct.pack(f">{len(x)}i", *x)
    name = lambda s: i4(len(s)) + s.encode() + b"\0" * (-len(s) % 4)

    def attr(k, v):
        if isinstance(v, str):
            raw, kind, n = v.encode("latin-1"), 2, len(v)
        else:
            raw, kind, n = np.array([v], ">f8" if isinstance(v, float) else ">i4").tobytes(), 6 if isinstance(v, float) else 4, 1
        return name(k) + i4(kind, n) + raw + b"\0" * (-len(raw) % 4)

    head = b"CDF\x01" + i4(0, 10, len(dims)) + b"".join(name(k) + i4(n) for k, n in dims.items())
    head += (i4(12, len(attrs)) + b"".join(attr(k, v) for k, v in attrs.items())) if attrs else i4(0, 0)
    head += i4(11, len(variables))
    entries, blobs = [], []
    for k, (dim, v) in variables.items():
        kind = CODES[v.dtype.str[1:]]
        raw = v.astype(TYPES[kind]).tobytes()
        raw += b"\0" * (-len(raw) % 4)
        entries.append((name(k) + i4(1, list(dims).index(dim), 0, 0, kind, len(raw)), len(raw)))
        blobs.append(raw)
    at = len(head) + sum(len(e) + 4 for e, _ in entries)
    for e, n in entries:
        head += e + i4(at)
        at += n
    with open(path, "wb") as f:
        f.write(head + b"".join(blobs))

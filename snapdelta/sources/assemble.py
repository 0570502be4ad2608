"""Assembles dex files from plain descriptions: for tests, and for a query whose answer is known."""

from __future__ import annotations

import struct


def leb(n):
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        if not n:
            return out + bytes([low])
        out += bytes([low | 0x80])


def mutf8(text):
    raw = text.encode("utf-16-le")
    units = struct.unpack(f"<{len(raw) // 2}H", raw)
    return b"".join(b"\xc0\x80" if u == 0 else chr(u).encode("utf-8", "surrogatepass") for u in units)


def build(classes):
    """A dex file. A class is (name, flags, parent, interfaces, fields, methods); a field (name, type, flags, encoded value
    or None), a method (name, result, parameters, flags, code or None). Code holds units and references: ("m", class, name,
    result, parameters), ("f", class, name, type), ("t", type), ("s", text)."""
    refs = {"s": set(), "t": set(), "f": set(), "m": set()}
    for name, _, parent, interfaces, fields, methods in classes:
        refs["t"] |= {name, *interfaces} | ({parent} if parent else set())
        refs["f"] |= {(name, f[0], f[1]) for f in fields}
        for label, result, params, _, code in methods:
            refs["m"].add((name, label, result, params))
            for unit in code or ():
                if isinstance(unit, tuple):
                    refs[unit[0]].add(unit[1:] if unit[0] in "fm" else unit[1])
    protos = sorted({m[2:] for m in refs["m"]})
    refs["t"] |= {x for f in refs["f"] for x in (f[0], f[2])} | {x for m in refs["m"] for x in (m[0], m[2], *m[3])}
    refs["s"] |= refs["t"] | {x[1] for x in refs["f"] | refs["m"]} | {"shorty"}
    index = {k: {x: i for i, x in enumerate(sorted(v))} for k, v in refs.items()}
    s, t, f, m = index["s"], index["t"], index["f"], index["m"]
    p = {x: i for i, x in enumerate(protos)}
    counts = [(len(s), 4), (len(t), 4), (len(p), 12), (len(f), 8), (len(m), 8), (len(classes), 32)]
    places, at = [], 0x70
    for n, size in counts:
        places.append(at)
        at += n * size
    data = b""

    def put(raw, align=4):
        nonlocal data
        data += b"\0" * (-(at + len(data)) % align)
        where = at + len(data)
        data += raw
        return where

    types = lambda names: put(struct.pack(f"<I{len(names)}H", len(names), *(t[x] for x in names))) if names else 0
    tables = [struct.pack("<I", put(leb(len(x)) + mutf8(x) + b"\0", 1)) for x in s]
    tables += [struct.pack("<I", s[x]) for x in t]
    tables += [struct.pack("<3I", s["shorty"], t[result], types(params)) for result, params in p]
    tables += [struct.pack("<HHI", t[c], t[kind], s[name]) for c, name, kind in f]
    tables += [struct.pack("<HHI", t[c], p[result, params], s[name]) for c, name, result, params in m]
    for name, flags, parent, interfaces, fields, methods in classes:

        def deltas(rows):
            out, last = b"", 0
            for number, *rest in sorted(rows):
                out += leb(number - last) + b"".join(map(leb, rest))
                last = number
            return out

        codes = {}
        for label, result, params, _, code in methods:
            if code is not None:
                units = [(index[u[0]][u[1:] if u[0] in "fm" else u[1]] if isinstance(u, tuple) else u) for u in code]
                codes[label, result, params] = put(struct.pack(f"<4HII{len(units)}H", 1, 1, 0, 0, 0, len(units), *units))
        static = sorted((x for x in fields if x[2] & 8), key=lambda x: f[name, x[0], x[1]])
        other = [x for x in fields if not x[2] & 8]
        direct = [x for x in methods if x[3] & 0x1000A]
        virtual = [x for x in methods if not x[3] & 0x1000A]
        body = b"".join(leb(len(x)) for x in (static, other, direct, virtual))
        body += b"".join(deltas([(f[name, x[0], x[1]], x[2]) for x in part]) for part in (static, other))
        body += b"".join(deltas([(m[name, *x[:3]], x[3], codes.get(x[:3], 0)) for x in part]) for part in (direct, virtual))
        values = [x[3] for x in static]
        while values and values[-1] is None:
            values.pop()
        constants = put(leb(len(values)) + b"".join(values), 1) if values else 0
        tables.append(struct.pack("<8I", t[name], flags, t[parent] if parent else 0xFFFFFFFF, types(interfaces), 0xFFFFFFFF, 0, put(body, 1) if fields or methods else 0, constants))
    pairs = [x for (n, _), where in zip(counts, places, strict=True) for x in (n, where if n else 0)]
    header = b"dex\n035\0" + bytes(24) + struct.pack("<IIIIII", at + len(data), 0x70, 0x12345678, 0, 0, 0) + struct.pack("<12I", *pairs) + struct.pack("<II", len(data), at)
    return header + b"".join(tables) + data

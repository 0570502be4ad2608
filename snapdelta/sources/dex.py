"""Android packages as a Python data source: a class row for each class of .apk, .jar, .zip and .dex files.

``spark.read.format("dex").option("snapshot", "a").load(path)`` takes a file or a folder and plans a
partition a package, since references don't leave their package; many packages are read in as many
tasks. Written from the public description of the Dalvik executable format.

What a row holds: declared members are those of the class definition, analysed ones these and the
methods that code calls on the class without its declaring them (inherited ones; external, without
code). Each instruction that calls a method, makes an instance, names a class or accesses a field is
a reference; a class's references to itself count for its members only. Classes that a package only
refers to are rows that aren't internal. Of a class that several dex files define the first is
taken. A folder or an archive without dex files has no rows; a file that isn't what its name says,
or breaks off, is an error that names it.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from snapdelta.schema import CLASS, ROOT

ARCHIVES = (".apk", ".jar", ".zip")
SUFFIXES = (*ARCHIVES, ".dex")
_NO_INDEX, _LITTLE_ENDIAN, _BATCH = 0xFFFFFFFF, 0x12345678, 256

#: Access flags by bit, as the format names them for methods and classes.
ACCESS = {
    0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x20: "synchronized", 0x40: "bridge", 0x80: "varargs", 0x100: "native",
    0x200: "interface", 0x400: "abstract", 0x800: "strictfp", 0x1000: "synthetic", 0x2000: "annotation", 0x4000: "enum", 0x10000: "constructor", 0x20000: "synchronized",
}
#: 16-bit units of an instruction, by ranges of opcodes; those not listed take one.
UNITS = {
    2: "02 05 08 13 15-16 19-1a 1c 1f-20 22-23 29 2d-3d 44-6d 90-af d0-e2 fe-ff",
    3: "03 06 09 14 17 1b 24-26 2a-2c 6e-72 74-78 fc-fd",
    4: "fa-fb",
    5: "18",
}
#: Opcodes that refer to a class or call a method, by the kind of reference.
CLASS_REFERENCES = {0x1C: "class_usage", 0x22: "new_instance"}
CALLS = {
    0x6E: "invoke_virtual", 0x6F: "invoke_super", 0x70: "invoke_direct", 0x71: "invoke_static", 0x72: "invoke_interface",
    0x74: "invoke_virtual_range", 0x75: "invoke_super_range", 0x76: "invoke_direct_range", 0x77: "invoke_static_range", 0x78: "invoke_interface_range",
}


def _ranges(text: str) -> list[int]:
    ends = [[int(x, 16) for x in part.split("-")] for part in text.split()]
    return [code for e in ends for code in range(e[0], e[-1] + 1)]


_SIZE = [1] * 256
for _units, _codes in UNITS.items():
    for _code in _ranges(_codes):
        _SIZE[_code] = _units
_READS = frozenset(_ranges("52-58 60-66"))
_WRITES = frozenset(_ranges("59-5f 67-6d"))


def access_string(flags: int) -> str:
    return " ".join(name for bit, name in ACCESS.items() if flags & bit)


def _text(raw: bytes) -> str:
    """Modified UTF-8: NUL takes two bytes, and characters beyond the first plane are surrogate pairs."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        halves = raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
        return halves.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


class Cursor:
    """Reads the variable-length numbers of a dex file."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def number(self) -> int:
        value = shift = 0
        while True:
            byte = self.data[self.at]
            self.at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the file breaks off")
        self.at += n
        return self.data[self.at - n : self.at]


class Dex:
    """The tables of a dex file, by index."""

    def __init__(self, data: bytes):
        if data[:4] != b"dex\n":
            raise ValueError("not a dex file")
        if struct.unpack_from("<I", data, 0x28)[0] != _LITTLE_ENDIAN:
            raise ValueError("not a little-endian dex file")
        self.data = data
        tables = struct.unpack_from("<12I", data, 0x38)
        rows = lambda k, form: list(struct.iter_unpack(form, self._slice(tables[2 * k + 1], tables[2 * k] * struct.calcsize(form))))
        self.strings = [self._string(at) for (at,) in rows(0, "<I")]
        self.types = [self.strings[i] for (i,) in rows(1, "<I")]
        self.protos = [f"({' '.join(self.type_list(at))}){self.types[result]}" for _, result, at in rows(2, "<3I")]
        self.fields = [(self.types[c], self.strings[name], self.types[t]) for c, t, name in rows(3, "<HHI")]
        self.methods = [(self.types[c], self.strings[name], self.protos[p]) for c, p, name in rows(4, "<HHI")]
        self.classes = rows(5, "<8I")

    def _slice(self, at: int, n: int) -> bytes:
        if at + n > len(self.data):
            raise ValueError("the file breaks off")
        return self.data[at : at + n]

    def _string(self, at: int) -> str:
        cursor = Cursor(self.data, at)
        cursor.number()
        return _text(self.data[cursor.at : self.data.index(b"\0", cursor.at)])

    def type_list(self, at: int) -> list[str]:
        if not at:
            return []
        (n,) = struct.unpack_from("<I", self.data, at)
        return [self.types[i] for i in struct.unpack_from(f"<{n}H", self.data, at + 4)]

    def members(self, at: int) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]:
        """(index, flags) of the static and the other fields; (index, flags, place of the code) of all methods."""
        if not at:
            return [[], []], []
        cursor = Cursor(self.data, at)
        sizes = [cursor.number() for _ in range(4)]
        fields: list[list[tuple[int, int]]] = []
        for n in sizes[:2]:
            index, found = 0, []
            for _ in range(n):
                index += cursor.number()
                found.append((index, cursor.number()))
            fields.append(found)
        methods = []
        for n in sizes[2:]:
            index = 0
            for _ in range(n):
                index += cursor.number()
                methods.append((index, cursor.number(), cursor.number()))
        return fields, methods

    def static_values(self, at: int) -> list[str]:
        if not at:
            return []
        cursor = Cursor(self.data, at)
        return [str(self._value(cursor)) for _ in range(cursor.number())]

    def _value(self, cursor: Cursor):
        """A constant. Null is None; members and types are their names; annotations are their type's name."""
        (head,) = cursor.take(1)
        kind, size = head & 0x1F, (head >> 5) + 1
        if kind == 0x1E:
            return None
        if kind == 0x1F:
            return size == 2
        if kind == 0x1C:
            return [self._value(cursor) for _ in range(cursor.number())]
        if kind == 0x1D:
            name = self.types[cursor.number()]
            for _ in range(cursor.number()):
                cursor.number()
                self._value(cursor)
            return name
        raw = cursor.take(size)
        if kind in (0x10, 0x11):  # the bytes left out are the low ones
            width, form = (4, "<f") if kind == 0x10 else (8, "<d")
            return struct.unpack(form, raw.rjust(width, b"\0"))[0]
        number = int.from_bytes(raw, "little", signed=kind in (0x00, 0x02, 0x04, 0x06))
        named = {0x17: self.strings, 0x18: self.types, 0x19: self.fields, 0x1A: self.methods, 0x1B: self.fields}.get(kind)
        if named is None:
            return number
        found = named[number]
        return found if isinstance(found, str) else "->".join(found)

    def instructions(self, at: int) -> Iterator[tuple[int, int]]:
        """(opcode, the index that follows it) in order; tables of switches and arrays have opcodes of their own."""
        (n,) = struct.unpack_from("<I", self.data, at + 12)
        units = struct.unpack_from(f"<{n}H", self.data, at + 16)
        i = 0
        while i < n:
            unit = units[i]
            code, size = unit & 0xFF, _SIZE[unit & 0xFF]
            if unit in (0x100, 0x200, 0x300) and i + 1 < n:
                code = unit
                if unit == 0x300:
                    size = 4 + (units[i + 1] * (units[i + 2] | units[i + 3] << 16) + 1) // 2 if i + 3 < n else n - i
                else:
                    size = 4 + 2 * units[i + 1] if unit == 0x100 else 2 + 4 * units[i + 1]
            yield code, units[i + 1] if size > 1 and i + 1 < n else 0
            i += size


@dataclass(slots=True)
class Method:
    descriptor: str
    access: str = ""
    external: bool = True
    opcodes: list[int] | None = None
    calls: list[str] = field(default_factory=list)  # access of each method called
    callers: list[str] = field(default_factory=list)

    def row(self, idx: int) -> dict:
        refs = lambda found: [{"peer_is_class": True, "peer_access": a} for a in found]
        return {"idx": idx, "declared": not self.external, "analysed": True, "is_external": self.external, "descriptor": self.descriptor, "access": self.access,
                "opcodes": self.opcodes, "xref_from": refs(self.callers), "xref_to": refs(self.calls)}


@dataclass(slots=True)
class Class:
    name: str
    access: str = ""
    extends: str = ROOT
    implements: list[str] = field(default_factory=list)
    internal: bool = False
    methods: dict[tuple[str, str], Method] = field(default_factory=dict)
    fields: dict[tuple[str, str], dict] = field(default_factory=dict)
    refers: list[tuple[str, str]] = field(default_factory=list)  # (peer, kind)
    referred: list[tuple[str, str]] = field(default_factory=list)

    def row(self, snapshot: str) -> dict:
        refs = lambda found: [{"peer": p, "kind": k} for p, k in found]
        return {"snapshot": snapshot, "class_name": self.name, "is_internal": self.internal, "access_flags": self.access, "extends": self.extends, "implements": self.implements,
                "methods": [m.row(i) for i, m in enumerate(self.methods.values())], "fields": [{"idx": i, **f} for i, f in enumerate(self.fields.values())],
                "xref_from": refs(self.referred), "xref_to": refs(self.refers)}


def analyse(files: list[bytes]) -> dict[str, Class]:
    """The classes of a package's dex files, by name: definitions first, then what their code refers to."""
    classes: dict[str, Class] = {}
    coded: list[tuple[Dex, Class, Method, int]] = []
    for dex in map(Dex, files):
        for index, flags, parent, interfaces, _, _, members, values in dex.classes:
            name = dex.types[index]
            if name in classes:
                continue
            made = classes[name] = Class(name, access_string(flags), ROOT if parent == _NO_INDEX else dex.types[parent], dex.type_list(interfaces), True)
            (static, other), methods = dex.members(members)
            constants = dex.static_values(values)
            for k, (number, bits) in enumerate(static + other):
                _, label, kind = dex.fields[number]
                init = constants[k] if k < min(len(static), len(constants)) else None
                made.fields[label, kind] = {"declared": True, "analysed": True, "descriptor": kind, "access": access_string(bits), "n_read": 0, "n_write": 0, "init_value": init}
            for number, bits, code in methods:
                _, label, proto = dex.methods[number]
                method = made.methods[label, proto] = Method(proto, access_string(bits), False)
                if code:
                    coded.append((dex, made, method, code))
    peers: dict[tuple[str, str], tuple[str, str]] = {}  # one tuple for all references of a kind to a class
    pair = lambda *key: peers.setdefault(key, key)

    def refer(source: Class, target: Class, kind: str) -> None:
        if source is not target:
            source.refers.append(pair(target.name, kind))
            target.referred.append(pair(source.name, kind))

    def known(name: str) -> Class | None:
        """The class of a type, or of an array's elements; basic types have none."""
        name = name.lstrip("[")
        if not name.startswith("L"):
            return None
        if name not in classes:
            classes[name] = Class(name)
        return classes[name]

    for dex, owner, method, at in coded:
        method.opcodes = []
        for code, index in dex.instructions(at):
            method.opcodes.append(code)
            if code in CALLS:
                name, label, proto = dex.methods[index]
                if target := known(name):
                    called = target.methods.setdefault((label, proto), Method(proto))
                    method.calls.append(called.access)
                    called.callers.append(method.access)
                    refer(owner, target, CALLS[code])
            elif code in CLASS_REFERENCES:
                if target := known(dex.types[index]):
                    refer(owner, target, CLASS_REFERENCES[code])
            elif code in _READS or code in _WRITES:
                name, label, kind = dex.fields[index]
                if name in classes and (accessed := classes[name].fields.get((label, kind))):
                    accessed["n_read" if code in _READS else "n_write"] += 1
    return classes


def dex_files(name: str, data: bytes) -> list[bytes]:
    """The dex files of a package in their order: classes.dex, classes2.dex and so on."""
    if not name.lower().endswith(ARCHIVES):
        return [data]
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        found = [(int(m[1] or 1), n) for n in archive.namelist() if (m := re.fullmatch(r"classes(\d*)\.dex", n))]
        return [archive.read(n) for _, n in sorted(found)]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


@dataclass
class Package(ds.InputPartition):
    path: str


class DexReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.snapshot = options["path"], options.get("snapshot", "a")
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> list[Package]:
        system, path = _open(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(path, recursive=True))
        return [Package(p) for p in sorted(f.path for f in found if f.is_file and (info.is_file or f.base_name.lower().endswith(SUFFIXES)))]

    def read(self, partition: Package | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without packages
            return
        system, _ = _open(self.path)
        with system.open_input_file(partition.path) as file:
            data = file.read()
        try:
            found = list(analyse(dex_files(partition.path, data)).values())
        except (ValueError, IndexError, RecursionError, struct.error, zipfile.BadZipFile) as e:
            raise ValueError(f"{partition.path}: {e}") from e
        for k in range(0, len(found), _BATCH):
            yield pa.RecordBatch.from_pylist([c.row(self.snapshot) for c in found[k : k + _BATCH]], schema=self.schema)


class DexDataSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "dex"

    def schema(self) -> str:
        return CLASS

    def reader(self, schema: StructType) -> DexReader:
        return DexReader(dict(self.options), schema)


def read_packages(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """Class rows of one snapshot from a package or a folder of packages."""
    spark.dataSource.register(DexDataSource)
    return spark.read.format("dex").option("snapshot", snapshot).load(path)

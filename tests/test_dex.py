import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from snapdelta.sources import dex
from snapdelta.sources.assemble import build, mutf8
from snapdelta.sources.tables import read_classes

ROOT = "Ljava/lang/Object;"

RUN = ("m", "Lb/B;", "run", "V", ("I", ROOT))
A = ("La/A;", 0x11, ROOT, (), [("count", "I", 0x0A, bytes([0x04, 0xFE])), ("name", "Ljava/lang/String;", 0x18, None), ("own", "J", 0x2, None)], [
    ("<init>", "V", (), 0x10001, [0x1070, ("m", ROOT, "<init>", "V", ()), 0, 0x0E]),
    ("go", "V", ("I",), 0x1, [0x0060, ("f", "La/A;", "count", "I"), 0x0067, ("f", "La/A;", "count", "I"), 0x0022, ("t", "Lb/B;"), 0x001C, ("t", "[[Lb/B;"), 0x001C, ("t", "[I"),
                              0x106E, RUN, 0, 0x106E, RUN, 0, 0x106E, ("m", "La/A;", "inherited", "I", ()), 0, 0x001A, ("s", "text"), 0x0E]),
    ("todo", "V", (), 0x401, None),
])
SWITCH = [0x002B, 4, 0, 0x0E, 0x0100, 1, 0, 0, 6, 0, 0x0300, 1, 3, 0, 0x0201, 0x0003, 0x0200, 1, 0, 0, 0, 0, 0x00]
B = ("Lb/B;", 0x1, "La/A;", ("Ljava/lang/Runnable;", "Lc/C;"), [], [("run", "V", ("I", ROOT), 0x1, SWITCH)])
C = ("Lc/C;", 0x601, ROOT, (), [], [])


@pytest.fixture
def packages(tmp_path):
    for name, parts in {"one": [build([A, B, C])], "two": [build([A]), build([B, C, A])]}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.apk", "w") as z:
            z.writestr("AndroidManifest.xml", b"")
            for k, part in enumerate(parts):
                z.writestr(f"classes{k + 1 if k else ''}.dex", part)
    (tmp_path / "plain.dex").write_bytes(build([A, B, C]))
    (tmp_path / "notes.txt").write_text("not a package")
    return tmp_path


def rows(df):
    return {r.class_name: r for r in df.collect()}


@pytest.mark.parametrize("name", ["one.apk", "two.apk", "plain.dex"])
def test_classes_of_a_package(spark, packages, name):
    found = rows(read_classes(spark, str(packages / name), "b"))
    assert {n for n, r in found.items() if r.is_internal} == {"La/A;", "Lb/B;", "Lc/C;"}
    assert {n for n, r in found.items() if not r.is_internal} == {ROOT} and all(r.snapshot == "b" for r in found.values())
    a, b, c = found["La/A;"], found["Lb/B;"], found["Lc/C;"]
    assert (a.access_flags, a.extends, b.extends, b.implements) == ("public final", ROOT, "La/A;", ["Ljava/lang/Runnable;", "Lc/C;"])
    assert c.access_flags == "public interface abstract" and c.methods == [] and c.fields == []
    assert {(f.descriptor, f.access, f.n_read, f.n_write, f.init_value) for f in a.fields} == {("I", "private static", 1, 1, "-2"), ("Ljava/lang/String;", "static final", 0, 0, None), ("J", "private", 0, 0, None)}
    init, go, todo, inherited = a.methods
    assert (init.descriptor, init.access, init.opcodes) == ("()V", "public constructor", [0x70, 0x0E])
    assert go.opcodes == [0x60, 0x67, 0x22, 0x1C, 0x1C, 0x6E, 0x6E, 0x6E, 0x1A, 0x0E] and todo.opcodes is None and todo.declared
    assert (inherited.declared, inherited.analysed, inherited.is_external, len(inherited.xref_from)) == (False, True, True, 1)
    assert [x.peer_access for x in go.xref_to] == ["public", "public", ""] and [x.peer_access for x in b.methods[0].xref_from] == ["public"] * 2
    assert b.methods[0].descriptor == f"(I {ROOT})V" and b.methods[0].opcodes == [0x2B, 0x0E, 0x100, 0x300, 0x200, 0x00]
    to_b = [("Lb/B;", k) for k in ("new_instance", "class_usage", "invoke_virtual", "invoke_virtual")]
    assert [(x.peer, x.kind) for x in a.xref_to] == [(ROOT, "invoke_direct"), *to_b] and a.xref_from == []
    assert [(x.peer, x.kind) for x in b.xref_from] == [("La/A;", k) for _, k in to_b]


def test_a_folder_is_read_package_by_package(spark, packages):
    df = read_classes(spark, str(packages), "a", "dex")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 12


def test_nothing_to_read_and_bad_files(spark, tmp_path):
    assert read_classes(spark, str(tmp_path), "a", "dex").count() == 0
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    assert read_classes(spark, str(tmp_path / "empty.zip"), "a").count() == 0
    for name, data in {"text.dex": b"no dex at all", "cut.dex": build([A, B, C])[:-40], "broken.apk": b"PK"}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=name):
            read_classes(spark, str(tmp_path / name), "a").collect()
    with pytest.raises(Exception, match="absent"):
        read_classes(spark, str(tmp_path / "absent.apk"), "a").collect()


def test_texts_and_constants():
    texts = ["", "plain", "é漢", "🙂 pair", "nul\0inside"]
    assert [dex._text(mutf8(x)) for x in texts] == texts

    class Names:
        strings, types, fields, methods = ["zero", "one"], ["LT;"], [("LC;", "f", "I")], [("LC;", "m", "()V")]
        _value = dex.Dex._value

    value = lambda raw: Names()._value(dex.Cursor(raw, 0))
    cases = {b"\x00\xff": -1, b"\x23\x00\x80": 0x8000, b"\x1e": None, b"\x3f": True, b"\x1f": False, b"\x17\x01": "one", b"\x18\x00": "LT;", b"\x1b\x00": "LC;->f->I", b"\x1c\x02\x04\x05\x1e": [5, None], b"\x1d\x00\x01\x00\x04\x07": "LT;"}
    assert {k: value(k) for k in cases} == cases
    assert value(b"\x70" + struct.pack("<f", 1.5)) == 1.5 and value(b"\x31" + struct.pack("<d", -2.0)[6:]) == -2.0


def test_sizes_cover_all_instructions():
    assert len(dex._SIZE) == 256 and [dex._SIZE[c] for c in (0x00, 0x01, 0x02, 0x03, 0x18, 0x2B, 0x38, 0x6E, 0xD0, 0xFA, 0xFF)] == [1, 1, 2, 3, 5, 3, 2, 3, 2, 4, 2]


def test_command_line_compares_packages(spark, packages):
    from snapdelta.cli import main

    folder = main([str(packages / "one.apk"), str(packages / "two.apk"), "--output", str(packages / "out")])
    status = {(r.class_name, r.status) for r in spark.read.parquet(f"{folder}/status").collect()}
    assert {("La/A;", "similar"), ("Lb/B;", "similar"), ("Lc/C;", "empty")} <= status
    assert spark.read.parquet(f"{folder}/status").where(F.col("status").isin("added", "deleted")).count() == 0

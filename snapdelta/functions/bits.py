"""Edit distances of strings of bits inside the JVM.

The class below is compiled by the compiler that Spark has for its own generated code, when it is first asked for,
and reaches executors as a jar. Its inner loop takes as many words at a time as the processor has lanes if Java's
vector module is there (Spark's launchers add it), else one after the other.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Myers 1999 and Hyyro 2003 by words of 64 rows. In step t word w is in column t - w, so what a word hands on in a
#: step is what the next one takes in the next: all words of a step are independent of each other.
#: The band holds diagonals from -edge to gap + edge. A word that enters it rises by one a row, and above the first
#: word left in it values rise by one a column: ways along the border, so no value is below the true one.
BAND = """
public class BitDistance implements org.apache.spark.sql.api.java.UDF2 {
    static final int SPARE = 16;

    public Object call(Object a, Object b) {
        return a == null || b == null ? null : (Object) Integer.valueOf(distance((byte[]) a, (byte[]) b));
    }

    public static int distance(byte[] a, byte[] b) {
        return distance(a, b, Integer.MAX_VALUE);
    }

    /** The distance, or -1 if it is above the most; it may be given then too. */
    public static int distance(byte[] a, byte[] b, int most) {
        if (a.length < b.length) {
            byte[] other = a;
            a = b;
            b = other;
        }
        int low = 0, high = 0;
        while (low < b.length && a[low] == b[low]) low++;
        while (high < b.length - low && a[a.length - 1 - high] == b[b.length - 1 - high]) high++;
        int n = a.length - low - high, m = b.length - low - high, gap = n - m, met = 0;
        for (int i = 0; i < n && met < m; i++) if (a[low + i] == b[low + met]) met++;
        if (met == m) return gap; // all of b in order, so the rest of a is put in
        if (gap >= most) return -1;
        long[] ones = new long[(n + 63 >>> 6) + SPARE], columns = new long[m + SPARE];
        for (int i = 0; i < n; i++) if (a[low + i] == '1') ones[i >>> 6] |= 1L << i;
        for (int j = 1; j <= m; j++) columns[m - j] = b[low + j - 1] == '1' ? 0L : -1L;
        int enough = (most - gap) / 2; // ways that leave so wide a band are longer than the most
        int edge = Math.min(enough, Math.max(64, Math.max(m / 64, Math.min(gap, m) / 6)));
        while (gap + 2 * edge < n) {
            int found = along(ones, columns, n, m, edge);
            if (found - gap <= 2 * edge + 1) return found; // no way that leaves the band is shorter
            if (gap + 2 * edge + 1 >= most) return -1;
            edge = Math.min(enough, (found - gap) / 2);
        }
        return along(ones, columns, n, m, m);
    }

    /** Never below the distance, and equal if a best way keeps to the band. */
    public static int along(long[] ones, long[] columns, int n, int m, int edge) {
        int gap = n - m, words = n + 63 >>> 6, from = 0, to = 0, cut = 0;
        long[] rise = new long[words + SPARE], fall = new long[words + SPARE];
        long[] up = new long[words + SPARE], down = new long[words + SPARE], nextUp = new long[words + SPARE], nextDown = new long[words + SPARE];
        up[0] = 1;
        nextUp[0] = 1;
        for (int t = 1; t < m + words; t++) {
            int end = Math.min(words, Math.min(t, (t - 1 + gap + edge) / 65 + 1));
            for (; to < end; to++) {
                rise[to] = -1L;
                fall[to] = 0L;
            }
            int left = Math.max(0, t - edge) / 65; // words before it are above the band
            from = Math.max(from, Math.max(left, t - m));
            int before = Math.max(0, t - 1 - edge) / 65; // what the last of them handed on in its last column is taken by now
            if (before > cut) {
                cut = before;
                up[cut] = 1L;
                nextUp[cut] = 1L;
                down[cut] = 0L;
                nextDown[cut] = 0L;
            }
            Wave.step(ones, columns, m - t, rise, fall, up, down, nextUp, nextDown, from, end);
            long[] taken = up;
            up = nextUp;
            nextUp = taken;
            taken = down;
            down = nextDown;
            nextDown = taken;
        }
        int distance = m;
        for (int w = 0; w < words; w++) {
            long own = w == words - 1 && (n & 63) != 0 ? (1L << n) - 1 : -1L;
            distance += Long.bitCount(rise[w] & own) - Long.bitCount(fall[w] & own);
        }
        return distance;
    }
}
"""

#: Codes come in fours, so they are packed by half bytes from their end: a sixth of what shuffles make of the characters.
PACKED = """
public class Pack implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object bits) {
        return bits == null ? null : pack((byte[]) bits);
    }

    static byte[] pack(byte[] bits) {
        byte[] fours = new byte[(bits.length + 3) / 4];
        for (int i = 1; i <= bits.length; i++) if (bits[bits.length - i] == '1') fours[fours.length - (i + 3) / 4] |= 1 << (i - 1) % 4;
        java.util.zip.Deflater by = new java.util.zip.Deflater();
        by.setInput(fours);
        by.finish();
        byte[] out = new byte[fours.length + fours.length / 8 + 64];
        int n = 4;
        while (!by.finished()) {
            if (n == out.length) out = java.util.Arrays.copyOf(out, 2 * n);
            n += by.deflate(out, n, out.length - n);
        }
        by.end();
        for (int i = 0; i < 4; i++) out[i] = (byte) (bits.length >>> 8 * i);
        return java.util.Arrays.copyOf(out, n);
    }

    static byte[] unpack(byte[] packed) throws Exception {
        int length = 0;
        for (int i = 0; i < 4; i++) length |= (packed[i] & 255) << 8 * i;
        byte[] fours = new byte[(length + 3) / 4], bits = new byte[length];
        java.util.zip.Inflater by = new java.util.zip.Inflater();
        by.setInput(packed, 4, packed.length - 4);
        for (int n = 0; n < fours.length; ) {
            int more = by.inflate(fours, n, fours.length - n);
            if (more == 0) throw new IllegalStateException("a packed code ends early");
            n += more;
        }
        by.end();
        for (int i = 1; i <= length; i++) bits[length - i] = (byte) ('0' + (fours[fours.length - (i + 3) / 4] >> (i - 1) % 4 & 1));
        return bits;
    }
}

public class PackedDistance implements org.apache.spark.sql.api.java.UDF2 {
    public Object call(Object a, Object b) throws Exception {
        return a == null || b == null ? null : (Object) Integer.valueOf(BitDistance.distance(Pack.unpack((byte[]) a), Pack.unpack((byte[]) b)));
    }
}
"""

#: An array of arrays of strings in few bytes: sizes (-1: null), then lengths of the strings (-1: null), then their bytes.
BAGS = """
public class Bags implements org.apache.spark.sql.api.java.UDF1 {
    public Object call(Object values) throws Exception {
        scala.collection.Seq sets = (scala.collection.Seq) values;
        java.io.ByteArrayOutputStream sizes = new java.io.ByteArrayOutputStream(), lengths = new java.io.ByteArrayOutputStream(), bytes = new java.io.ByteArrayOutputStream();
        for (int i = 0; i < sets.length(); i++) {
            scala.collection.Seq set = (scala.collection.Seq) sets.apply(i);
            put(sizes, set == null ? -1 : set.length());
            for (int j = 0; set != null && j < set.length(); j++) {
                Object text = set.apply(j);
                byte[] own = text == null ? new byte[0] : ((String) text).getBytes("UTF-8");
                put(lengths, text == null ? -1 : own.length);
                bytes.write(own, 0, own.length);
            }
        }
        java.io.ByteArrayOutputStream out = new java.io.ByteArrayOutputStream();
        java.util.zip.DeflaterOutputStream by = new java.util.zip.DeflaterOutputStream(out);
        by.write(sizes.toByteArray());
        by.write(lengths.toByteArray());
        by.write(bytes.toByteArray());
        by.close();
        return out.toByteArray();
    }

    static void put(java.io.ByteArrayOutputStream out, int value) {
        for (int i = 0; i < 4; i++) out.write(value >>> 8 * i);
    }
}
"""

#: Distances of a code to others, the most promising first; -1 where the total can't reach the best so far. Without a code of
#: its own the other one is the same. A distance within which a total can reach the best bounds the band.
BEST = """
public class BestDistances implements org.apache.spark.sql.api.java.UDF5 {
    static final double NEAR = 2e-7;

    public Object call(Object own, Object others, Object bases, Object uppers, Object floor) throws Exception {
        scala.collection.Seq codes = (scala.collection.Seq) others, base = (scala.collection.Seq) bases, upper = (scala.collection.Seq) uppers;
        double best = ((Double) floor).doubleValue();
        byte[] bits = null;
        Integer[] found = new Integer[codes.length()];
        for (int i = 0; i < found.length; i++) {
            double rest = ((Double) base.apply(i)).doubleValue(), room = best - NEAR - rest;
            int distance = -1;
            byte[] other = (byte[]) codes.apply(i);
            if (other == null) {
                distance = 0;
            } else if (((Double) upper.apply(i)).doubleValue() >= best - NEAR) {
                if (bits == null) bits = Pack.unpack((byte[]) own);
                int most = room > 1e-4 ? (int) Math.ceil(0.0144 / (room * room)) + 1 : Integer.MAX_VALUE;
                distance = BitDistance.distance(bits, Pack.unpack(other), most);
            }
            if (distance >= 0) best = Math.max(best, rest + (distance == 0 ? 0.15 : 0.12 / Math.sqrt((double) distance)));
            found[i] = Integer.valueOf(distance);
        }
        return found;
    }
}
"""

PLAIN = """
class Wave {
    static void step(long[] ones, long[] columns, int at, long[] rise, long[] fall, long[] up, long[] down, long[] nextUp, long[] nextDown, int from, int to) {
        for (int w = from; w < to; w++) {
            long less = down[w], p = rise[w], q = fall[w], same = ones[w] ^ columns[at + w];
            long either = same | q;
            same |= less;
            long diagonal = (((same & p) + p) ^ p) | same;
            long more = q | ~(diagonal | p), fewer = p & diagonal;
            nextUp[w + 1] = more >>> 63;
            nextDown[w + 1] = fewer >>> 63;
            more = more << 1 | up[w];
            rise[w] = fewer << 1 | less | ~(either | more);
            fall[w] = more & either;
        }
    }
}
"""

#: The same by lanes. Lanes past the last word are set anew before they count.
LANES = """
class Wave {
    static final VectorSpecies KIND = LongVector.SPECIES_PREFERRED;

    static Vector of(long[] values, int at) {
        return LongVector.fromArray(KIND, values, at);
    }

    static void step(long[] ones, long[] columns, int at, long[] rise, long[] fall, long[] up, long[] down, long[] nextUp, long[] nextDown, int from, int to) {
        for (int w = from; w < to; w += KIND.length()) {
            Vector less = of(down, w), p = of(rise, w), q = of(fall, w), same = of(ones, w).lanewise(VectorOperators.XOR, of(columns, at + w));
            Vector either = same.lanewise(VectorOperators.OR, q);
            same = same.lanewise(VectorOperators.OR, less);
            Vector diagonal = same.lanewise(VectorOperators.AND, p).lanewise(VectorOperators.ADD, p).lanewise(VectorOperators.XOR, p).lanewise(VectorOperators.OR, same);
            Vector more = diagonal.lanewise(VectorOperators.OR, p).lanewise(VectorOperators.NOT).lanewise(VectorOperators.OR, q), fewer = p.lanewise(VectorOperators.AND, diagonal);
            ((LongVector) more.lanewise(VectorOperators.LSHR, 63L)).intoArray(nextUp, w + 1);
            ((LongVector) fewer.lanewise(VectorOperators.LSHR, 63L)).intoArray(nextDown, w + 1);
            more = more.lanewise(VectorOperators.LSHL, 1L).lanewise(VectorOperators.OR, of(up, w));
            fewer = fewer.lanewise(VectorOperators.LSHL, 1L).lanewise(VectorOperators.OR, less);
            ((LongVector) either.lanewise(VectorOperators.OR, more).lanewise(VectorOperators.NOT).lanewise(VectorOperators.OR, fewer)).intoArray(rise, w);
            ((LongVector) more.lanewise(VectorOperators.AND, either)).intoArray(fall, w);
        }
    }
}
"""

#: By application: what loads the classes, after their jar was handed out.
_made: dict[str, object] = {}


def compiled(spark: SparkSession, lanes: bool):
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Class.forName("org.apache.spark.sql.api.java.UDF2").getClassLoader())  # without jars added before
    imports = "import jdk.incubator.vector.*;" if lanes else ""
    compiler.cook(f"package snapdelta; {imports} {BAND} {PACKED} {BAGS} {BEST} {LANES if lanes else PLAIN}")
    return compiler


def _loader(spark: SparkSession):
    """Of the classes in this JVM; executors get them as a jar."""
    key = spark.sparkContext.applicationId
    if key not in _made:
        try:
            compiler = compiled(spark, lanes=True)
        except Py4JJavaError:  # no vector module
            compiler = compiled(spark, lanes=False)
        path = Path(tempfile.mkdtemp(prefix="snapdelta-"), "bit-distance.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sparkContext._jsc.addJar(path.as_uri())
        _made[key] = compiler.getClassLoader()
    return _made[key]


def _called(spark: SparkSession, name: str, kind: str, *values: Column) -> Column:
    types = spark.sparkContext._jvm.org.apache.spark.sql.types.DataTypes
    of = types.createArrayType(types.IntegerType) if kind == "ArrayType" else getattr(types, kind)
    spark._jsparkSession.udf().register(f"snapdelta_{name}", _loader(spark).loadClass(f"snapdelta.{name}").newInstance(), of)
    return F.call_function(f"snapdelta_{name}", *values)


def bit_distances(spark: SparkSession, a: Column, b: Column) -> Column:
    """Edit distance of two strings of the characters 0 and 1."""
    return _called(spark, "BitDistance", "IntegerType", a.cast("binary"), b.cast("binary"))


def packed(spark: SparkSession, bits: Column) -> Column:
    """A string of the characters 0 and 1 in few bytes."""
    return _called(spark, "Pack", "BinaryType", bits.cast("binary"))


def packed_distances(spark: SparkSession, a: Column, b: Column) -> Column:
    """Edit distance of two strings that are ``packed``."""
    return _called(spark, "PackedDistance", "IntegerType", a, b)


def best_distances(spark: SparkSession, own: Column, others: Column, bases: Column, uppers: Column, floor: Column) -> Column:
    """Edit distances of a ``packed`` string to an array of others (null: the same), -1 where base and code can't reach ``floor`` or a total before it."""
    return _called(spark, "BestDistances", "ArrayType", own, others, bases, uppers, floor)


def bags(spark: SparkSession, *sets: Column) -> Column:
    """Arrays of strings in few bytes, see ``BAGS``."""
    return _called(spark, "Bags", "BinaryType", F.array(*sets))

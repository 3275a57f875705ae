"""The coder and the counters of op10 in the JVM: bits depend on each other, so neither columns nor batches can express them at speed,
and counting there spares each text and word the way to Python and back.

The Java source below is compiled once by the compiler that Spark itself uses for generated code, put into an archive
in the shared folder and added to the session, which hands it to all executors, also to those that join later. The
model is a broadcast, read in place by all tasks of an executor.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASS = "corpusloom.Mixer"
#: Bytes of a model that go to the JVM at a time, as they travel as text.
PIECE = 1 << 20
SOURCE = r"""
package corpusloom;

/** Hashes of contexts. */
final class Hash {
  static final int M1 = 0x9E3779B1, M2 = 0x85EBCA6B, M3 = 0xC2B2AE35, ODD = 0x01000193;

  static int stir(int h) {
    h = (h ^ (h >>> 15)) * M1;
    return h ^ (h >>> 13);
  }

  /** Of at most so many bytes before the n-th of a word. */
  static int near(byte[] word, int n, int order) {
    int sum = 0, power = ODD;
    for (int d = 1; d <= order && d <= n; d++) {
      sum += ((word[n - d] & 255) + 1) * power;
      power *= ODD;
    }
    return stir(sum);
  }

  /** The context, with a common word beside it. */
  static int ranked(int h, int rank) {
    return stir(h + (rank + 1) * M3);
  }

  /** The first of the 64 slots of a context; a node's is (h + node * M2) >>> 26 further on. */
  static int slots(int h, int bits) {
    return h * M1 >>> 38 - bits << 6;
  }
}

/** The words of a text: bytes of A-Z lower-cased, between white space. */
final class Tokens {
  byte[] word = new byte[64];
  int n, whole;
  private byte[] text;
  private int at;

  void read(byte[] given) {
    text = given;
    at = 0;
  }

  /** Whether there is another word; it is the first n bytes of word, whole its hash before stirring. */
  boolean next() {
    n = 0;
    whole = 0;
    if (text == null) return false;
    int power = 1;
    while (at < text.length) {
      int b = text[at++];
      if (b == 32 || b >= 9 && b <= 13) {
        if (n > 0) return true;
        continue;
      }
      if (b >= 65 && b <= 90) b += 32;
      if (n == word.length) word = java.util.Arrays.copyOf(word, (int) Math.min(2L * n, Integer.MAX_VALUE - 16));
      word[n++] = (byte) b;
      whole += ((b & 255) + 1) * power;
      power *= Hash.ODD;
    }
    text = null;
    return n > 0;
  }
}

/** Words and their numbers from 0 on, as bytes within other bytes: their count, then the length and bytes of each. */
final class Listed {
  final byte[] all;
  final int[] from;
  final int size, behind;
  private final int[] slot;

  Listed(byte[] all, int at) {
    java.nio.ByteBuffer in = java.nio.ByteBuffer.wrap(all).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    in.position(at);
    this.all = all;
    size = in.getInt();
    from = new int[size];
    slot = new int[Integer.highestOneBit(Math.max(size, 256)) << 2];
    for (int k = 0; k < size; k++) {
      int long_ = in.getInt(), whole = 0, power = 1;
      from[k] = in.position();
      for (int i = 0; i < long_; i++) {
        whole += ((all[from[k] + i] & 255) + 1) * power;
        power *= Hash.ODD;
      }
      in.position(from[k] + long_);
      int s = Hash.stir(whole) & slot.length - 1;
      while (slot[s] > 0) s = s + 1 & slot.length - 1;
      slot[s] = k + 1;
    }
    behind = in.position();
  }

  int length(int k) {
    return all[from[k] - 4] & 255 | (all[from[k] - 3] & 255) << 8 | (all[from[k] - 2] & 255) << 16 | all[from[k] - 1] << 24;
  }

  /** The number of a word, or -1. */
  int find(byte[] word, int n, int whole) {
    for (int s = Hash.stir(whole) & slot.length - 1; slot[s] > 0; s = s + 1 & slot.length - 1) {
      int k = slot[s] - 1;
      if (length(k) == n && java.util.Arrays.equals(all, from[k], from[k] + n, word, 0, n)) return k;
    }
    return -1;
  }
}

/** Paths of the trees: for a byte before and a byte, from where on and how many decisions, each a node and a bit. */
final class Paths {
  final int[] first = new int[65536], size = new int[65536], path;

  Paths(java.nio.ByteBuffer in) {
    for (int k = 0; k < 65536; k++) first[k] = in.getInt();
    for (int k = 0; k < 65536; k++) size[k] = in.getInt();
    path = new int[in.getInt()];
    for (int k = 0; k < path.length; k++) path[k] = in.getInt();
  }
}

/** Bytes that all executors read; they come in pieces. */
final class Sent implements java.io.Serializable {
  final org.apache.spark.broadcast.Broadcast bytes;

  Sent(org.apache.spark.api.java.JavaSparkContext sc, java.io.ByteArrayOutputStream given) {
    bytes = sc.broadcast(given.toByteArray());
    given.reset();
  }

  byte[] get() {
    return (byte[]) bytes.value();
  }
}

/** What a task counts and passes on, again and again, whenever it has most of them. */
abstract class Counter implements org.apache.spark.api.java.function.MapPartitionsFunction {
  protected final int most;
  /** How many are held, and the next one to pass on; -1 while counting. */
  protected transient int held, out;

  Counter(int most) {
    this.most = most;
  }

  abstract void begin();

  /** Counts on until there are enough or the rows end. */
  abstract void fill(java.util.Iterator rows);

  abstract boolean left(java.util.Iterator rows);

  abstract org.apache.spark.sql.Row pass();

  public java.util.Iterator call(final java.util.Iterator rows) {
    begin();
    out = -1;
    return new java.util.Iterator() {
      public boolean hasNext() {
        while (held == 0) {
          out = -1;
          if (!left(rows)) return false;
          fill(rows);
          out = 0;
        }
        return true;
      }

      public Object next() {
        if (!hasNext()) throw new java.util.NoSuchElementException();
        return pass();
      }
    };
  }

  static byte[] bytes(Object row) {
    return ((org.apache.spark.sql.Row) row).isNullAt(0) ? null : (byte[]) ((org.apache.spark.sql.Row) row).get(0);
  }
}

/** Rows of a text: words and how often they occur. */
final class WordCounter extends Counter {
  private static final int MOST_BYTES = 1 << 26;
  private transient Tokens tokens;
  private transient boolean more;
  private transient byte[] pool;
  private transient int[] slot, from, whole;
  private transient long[] n;
  private transient int used, words;

  WordCounter(int most) {
    super(most);
  }

  void begin() {
    tokens = new Tokens();
    more = false;
    pool = new byte[1 << 16];
    slot = new int[1 << 13];
    from = new int[1 << 12];
    whole = new int[1 << 12];
    n = new long[1 << 12];
    used = words = held = 0;
  }

  boolean left(java.util.Iterator rows) {
    return more || rows.hasNext();
  }

  void fill(java.util.Iterator rows) {
    java.util.Arrays.fill(slot, 0);
    used = words = 0;
    while (words < most && used < MOST_BYTES) {
      if (more && tokens.next()) add();
      else if (more = rows.hasNext()) tokens.read(bytes(rows.next()));
      else break;
    }
    held = words;
  }

  private void add() {
    int mask = slot.length - 1, s = Hash.stir(tokens.whole) & mask;
    for (; slot[s] > 0; s = s + 1 & mask) {
      int k = slot[s] - 1;
      if (whole[k] == tokens.whole && end(k) - from[k] == tokens.n && java.util.Arrays.equals(pool, from[k], end(k), tokens.word, 0, tokens.n)) {
        n[k]++;
        return;
      }
    }
    if (words == from.length) {
      from = java.util.Arrays.copyOf(from, 2 * words);
      whole = java.util.Arrays.copyOf(whole, 2 * words);
      n = java.util.Arrays.copyOf(n, 2 * words);
      slot = new int[2 * slot.length];
      mask = slot.length - 1;
      for (int k = 0; k < words; k++) {
        int at = Hash.stir(whole[k]) & mask;
        while (slot[at] > 0) at = at + 1 & mask;
        slot[at] = k + 1;
      }
      s = Hash.stir(tokens.whole) & mask;
      while (slot[s] > 0) s = s + 1 & mask;
    }
    long need = (long) used + tokens.n;
    if (need > pool.length) pool = java.util.Arrays.copyOf(pool, (int) Math.min(Math.max(need, 2L * pool.length), Integer.MAX_VALUE - 16));
    System.arraycopy(tokens.word, 0, pool, used, tokens.n);
    from[words] = used;
    whole[words] = tokens.whole;
    n[words] = 1;
    slot[s] = ++words;
    used += tokens.n;
  }

  private int end(int k) {
    return k + 1 < words ? from[k + 1] : used;
  }

  org.apache.spark.sql.Row pass() {
    int k = out++;
    held--;
    return org.apache.spark.sql.RowFactory.create(new Object[] {java.util.Arrays.copyOfRange(pool, from[k], end(k)), Long.valueOf(n[k])});
  }
}

/**
 * Rows of a text: runs of bytes beside their common words, and how often they occur. A run is one number: how many bytes of the word
 * stand before a byte, three at most, those bytes, the nearest last, and the byte itself; the rank of the common word goes above.
 */
final class RunCounter extends Counter {
  private final byte[] common;
  private transient Listed ranks;
  private transient Tokens tokens;
  private transient long[] key, n;

  RunCounter(int most, byte[] common) {
    super(most);
    this.common = common;
  }

  void begin() {
    ranks = new Listed(common, 0);
    tokens = new Tokens();
    key = new long[1 << 12];
    n = new long[1 << 12];
    held = 0;
  }

  boolean left(java.util.Iterator rows) {
    return rows.hasNext();
  }

  void fill(java.util.Iterator rows) {
    java.util.Arrays.fill(key, 0);
    while (held < most && rows.hasNext()) {
      tokens.read(bytes(rows.next()));
      long rank = 0;
      while (tokens.next()) {
        byte[] word = tokens.word;
        int before = 0;
        for (int k = 0; k < tokens.n; k++) {
          add(rank << 34 | (long) Math.min(k, 3) << 32 | (long) before << 8 & 0xFFFFFF00L | word[k] & 255);
          before = (before << 8 | word[k] & 255) & 0xFFFFFF;
        }
        add(rank << 34 | (long) Math.min(tokens.n, 3) << 32 | (long) before << 8 & 0xFFFFFF00L | 32);
        int r = ranks.find(word, tokens.n, tokens.whole);
        if (r >= 0) rank = r + 1;
      }
      add(rank << 34 | 10);
    }
  }

  private static int spread(long k) {
    k = (k ^ k >>> 29) * 0x9E3779B97F4A7C15L;
    return (int) (k >>> 32);
  }

  private void add(long k) {
    k++; // 0 is a free place
    int mask = key.length - 1, s = spread(k) & mask;
    for (; key[s] != 0; s = s + 1 & mask) {
      if (key[s] == k) {
        n[s]++;
        return;
      }
    }
    key[s] = k;
    n[s] = 1;
    if (2 * ++held > key.length) {
      long[] old = key, times = n;
      key = new long[2 * old.length];
      n = new long[2 * old.length];
      mask = key.length - 1;
      for (int i = 0; i < old.length; i++) {
        if (old[i] == 0) continue;
        s = spread(old[i]) & mask;
        while (key[s] != 0) s = s + 1 & mask;
        key[s] = old[i];
        n[s] = times[i];
      }
    }
  }

  org.apache.spark.sql.Row pass() {
    while (key[out] == 0) out++;
    held--;
    return org.apache.spark.sql.RowFactory.create(new Object[] {Long.valueOf(key[out] - 1), Long.valueOf(n[out++])});
  }
}

/** Rows of a word, null for the end, and its count: pairs of neighbouring bytes and how often they occur. */
final class PairCounter extends Counter {
  private transient long[] n;

  PairCounter() {
    super(0);
  }

  void begin() {
    n = new long[65536];
    held = 0;
  }

  boolean left(java.util.Iterator rows) {
    return rows.hasNext();
  }

  void fill(java.util.Iterator rows) {
    while (rows.hasNext()) {
      Object row = rows.next();
      byte[] word = bytes(row);
      long times = ((org.apache.spark.sql.Row) row).getLong(1);
      int before = 32;
      for (int k = 0; word != null && k < word.length; k++) {
        n[before << 8 | word[k] & 255] += times;
        before = word[k] & 255;
      }
      n[before << 8 | (word == null ? 10 : 32)] += times;
    }
    for (int k = 0; k < 65536; k++) if (n[k] != 0) held++;
  }

  org.apache.spark.sql.Row pass() {
    while (n[out] == 0) out++;
    held--;
    return org.apache.spark.sql.RowFactory.create(new Object[] {Integer.valueOf(out), Long.valueOf(n[out++])});
  }
}

/**
 * The sums of a table's slots over rows of a word, null for the end, and its count, or of a run and its count: ranges of 1 << chunk slots
 * with a one and a zero sum each, compressed. order: bytes before, 0 for the whole word so far, -1 for runs.
 */
final class SlotCounter extends Counter {
  private final Sent trees;
  private final int order, bits, chunk;
  private transient Paths paths;
  private transient long[][] sums;
  private transient byte[] said;

  SlotCounter(Sent trees, int order, int bits, int chunk) {
    super(0);
    this.trees = trees;
    this.order = order;
    this.bits = bits;
    this.chunk = chunk;
  }

  void begin() {
    paths = new Paths(java.nio.ByteBuffer.wrap(trees.get()).order(java.nio.ByteOrder.LITTLE_ENDIAN));
    sums = new long[1 << bits - chunk][];
    said = new byte[4];
    held = 0;
  }

  boolean left(java.util.Iterator rows) {
    return rows.hasNext();
  }

  void fill(java.util.Iterator rows) {
    while (rows.hasNext()) {
      org.apache.spark.sql.Row row = (org.apache.spark.sql.Row) rows.next();
      long times = row.getLong(1);
      if (order < 0) {
        long key = row.getLong(0);
        int have = (int) (key >>> 32 & 3);
        for (int d = 1; d <= have; d++) said[have - d] = (byte) (key >>> 8 * d);
        add(have == 0 ? 32 : said[have - 1] & 255, (int) key & 255, Hash.ranked(Hash.near(said, have, 3), (int) (key >>> 34)), times);
        continue;
      }
      byte[] word = bytes(row);
      int long_ = word == null ? 0 : word.length, whole = 0, power = 1;
      for (int k = 0; k <= long_; k++) {
        int c = k < long_ ? word[k] & 255 : word == null ? 10 : 32;
        add(k == 0 ? 32 : word[k - 1] & 255, c, order > 0 ? Hash.near(word, k, order) : Hash.stir(whole), times);
        whole += (c + 1) * power;
        power *= Hash.ODD;
      }
    }
    for (int k = 0; k < sums.length; k++) if (sums[k] != null) held++;
  }

  private void add(int before, int c, int h, long times) {
    int key = before << 8 | c, at = paths.first[key], base = Hash.slots(h, bits);
    long[] sum = sums[base >>> chunk];
    if (sum == null) sum = sums[base >>> chunk] = new long[2 << chunk];
    base &= (1 << chunk) - 1;
    for (int end = at + paths.size[key]; at < end; at++) {
      int step = paths.path[at];
      sum[base + (h + (step >>> 1) * Hash.M2 >>> 26) << 1 | step & 1] += times;
    }
  }

  org.apache.spark.sql.Row pass() {
    while (sums[out] == null) out++;
    held--;
    java.nio.ByteBuffer raw = java.nio.ByteBuffer.allocate(16 << chunk).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    raw.asLongBuffer().put(sums[out]);
    sums[out] = null;
    return org.apache.spark.sql.RowFactory.create(new Object[] {Integer.valueOf(out++), com.github.luben.zstd.Zstd.compress(raw.array(), 1)});
  }
}

/** What is read from a model; tables stay where they are. */
final class Model {
  private static final java.util.Map READ = new java.util.WeakHashMap();
  /** The logistic curve from -EDGE to EDGE in FINE steps a unit, straight between them: off by less than one part in 100,000. */
  static final double EDGE = 15, FINE = 256;
  final int predictors, gates, middle;
  final double rate, step;
  final double[] start, curve, slope, headLog;
  /** Log-odds in FINE steps a unit; from a table, as conversions of whole numbers wait for each other. */
  final double[] odds = new double[128];
  final int[] table, width, headRank;
  final Paths paths;
  final Listed common, head;
  /** Lookups of frequent words, made when they are first met; their bytes are always the same. */
  final java.util.concurrent.atomic.AtomicReferenceArray known;

  /** The one that all tasks of an executor share. It is keyed by the bytes it was read from, and goes with them. */
  static Model of(byte[] all) {
    synchronized (READ) {
      java.lang.ref.SoftReference got = (java.lang.ref.SoftReference) READ.get(all);
      Model model = got == null ? null : (Model) got.get();
      if (model == null) {
        model = new Model(all);
        READ.put(all, new java.lang.ref.SoftReference(model));
      }
      return model;
    }
  }

  private Model(byte[] all) {
    java.nio.ByteBuffer in = java.nio.ByteBuffer.wrap(all).order(java.nio.ByteOrder.LITTLE_ENDIAN);
    predictors = in.getInt();
    gates = in.getInt();
    middle = in.getInt();
    rate = in.getDouble();
    step = in.getDouble();
    for (int k = 0; k < odds.length; k++) odds[k] = (k - 64) * step * FINE;
    start = new double[predictors * gates];
    for (int k = 0; k < start.length; k++) start[k] = in.getDouble();
    paths = new Paths(in);
    common = new Listed(all, in.position());
    in.position(common.behind);
    table = new int[predictors];
    width = new int[predictors];
    for (int k = 0; k < predictors; k++) {
      width[k] = in.getInt();
      table[k] = in.position();
      in.position(table[k] + (1 << width[k]));
    }
    head = new Listed(all, in.position());
    in.position(head.behind);
    headLog = new double[head.size];
    headRank = new int[head.size];
    known = new java.util.concurrent.atomic.AtomicReferenceArray(head.size);
    for (int k = 0; k < head.size; k++) headLog[k] = in.getDouble();
    Tokens tokens = new Tokens();
    for (int k = 0; k < head.size; k++) {
      tokens.read(java.util.Arrays.copyOfRange(all, head.from[k], head.from[k] + head.length(k)));
      headRank[k] = tokens.next() ? common.find(tokens.word, tokens.n, tokens.whole) + 1 : 0;
    }
    int n = (int) (2 * EDGE * FINE);
    curve = new double[n + 1];
    slope = new double[n + 1];
    double at = 1 / (1 + Math.exp(-EDGE));
    for (int k = 0; k <= n; k++) {
      double next = 1 / (1 + Math.exp((k + 1) / FINE - EDGE));
      slope[k] = next - at;
      curve[k] = at - k * slope[k];
      at = next;
    }
  }
}

/** Scores a text; the counts that the base score needs as well if asked for all. */
public final class Mixer implements org.apache.spark.sql.api.java.UDF1 {
  private static final int SPACE = 32, END = 10;
  private static final double LEAST = 1e-6;
  /** Bytes of a word that are looked up at a time, and what is kept of a word at most. */
  private static final int PART = 64, KEPT = 1 << 12;
  private final Sent bytes;
  private final boolean whole;

  private transient byte[] all;
  private transient Model model;
  private transient Tokens tokens;

  // The text that is being coded.
  private transient double[] w;
  private transient double log, product;

  /** What is looked up of the bytes being coded: for each the hash of three bytes before; how many decisions, and how
      often longer contexts were seen; and for each decision the node's hash, and log-odds of three predictors for the bit taken. */
  private transient int[] found;
  private transient int end;

  public Mixer(Sent bytes, boolean whole) {
    this.bytes = bytes;
    this.whole = whole;
  }

  private void open() {
    all = bytes.get();
    model = Model.of(all);
    tokens = new Tokens();
    w = new double[model.start.length];
    found = new int[1 << 12];
  }

  /** Looks up one byte c behind the n bytes of the word so far. */
  private void look(byte[] word, int n, int c, int sum) {
    byte[] all = this.all;
    int[] path = model.paths.path, width = model.width;
    int h0 = Hash.near(word, n, 3), h1 = Hash.near(word, n, 5), h2 = Hash.stir(sum);
    int l0 = model.table[0] + Hash.slots(h0, width[0]), l1 = model.table[1] + Hash.slots(h1, width[1]), l2 = model.table[2] + Hash.slots(h2, width[2]);
    int key = (n == 0 ? SPACE : word[n - 1] & 255) << 8 | c, at = model.paths.first[key], many = model.paths.size[key], middle = model.middle, seen = -1;
    if (end + 2 + 2 * many > found.length) found = java.util.Arrays.copyOf(found, 2 * (end + 2 + 2 * many));
    int[] found = this.found;
    int head = end, e = end + 2;
    for (int stop = at + many; at < stop; at++) {
      int node = (path[at] >>> 1) * Hash.M2;
      int c0 = all[l0 + (h0 + node >>> 26)] & 255, c1 = all[l1 + (h1 + node >>> 26)] & 255, c2 = all[l2 + (h2 + node >>> 26)] & 255;
      if (seen < 0) seen = (c2 & 3) == 3 ? 3 : Math.min(c1 & 3, 2);
      int bit = path[at] & 1, sign = 2 * bit - 1;
      found[e++] = node;
      found[e++] = bit << 24 | ((c0 >> 2) - middle) * sign + 64 | ((c1 >> 2) - middle) * sign + 64 << 8 | ((c2 >> 2) - middle) * sign + 64 << 16;
    }
    found[head] = h0;
    found[head + 1] = seen << 16 | many;
    end = e;
  }

  /** Codes what was looked up, behind a common word. */
  private void code(int[] found, int end, int rank) {
    byte[] all = this.all;
    double[] w = this.w, curve = model.curve, slope = model.slope, odds = model.odds;
    int table3 = model.table[3], width3 = model.width[3], middle = model.middle, last = curve.length - 1;
    double rate = model.rate / Model.FINE, zero = Model.EDGE * Model.FINE, product = this.product;
    for (int e = 0; e < end; ) {
      int h3 = Hash.ranked(found[e], rank), head = found[e + 1], l3 = table3 + Hash.slots(h3, width3);
      e += 2;
      int gate = 4 * ((head >>> 16) + 4 * (all[l3 + (h3 + found[e] >>> 26)] & 3));
      double w0 = w[gate], w1 = w[gate + 1], w2 = w[gate + 2], w3 = w[gate + 3];
      // Weights lag one decision behind, and what the last error adds to the sum is told apart: it is all that a decision waits for.
      double error = 0, y0 = 0, y1 = 0, y2 = 0, y3 = 0;
      for (int stop = e + 2 * (head & 0xFFFF); e < stop; e += 2) {
        int p = found[e + 1], c3 = (all[l3 + (h3 + found[e] >>> 26)] & 255) >> 2;
        double x0 = odds[p & 127], x1 = odds[p >>> 8 & 127], x2 = odds[p >>> 16 & 127], x3 = odds[(c3 - middle) * ((p >>> 24) * 2 - 1) + 64];
        double z = (w0 * x0 + w1 * x1 + (w2 * x2 + w3 * x3) + zero) + error * (rate * (x0 * y0 + x1 * y1 + (x2 * y2 + x3 * y3)));
        double step = error * rate;
        w0 += step * y0;
        w1 += step * y1;
        w2 += step * y2;
        w3 += step * y3;
        if (z < 0) z = 0;
        else if (z > last) z = last;
        int i = (int) z;
        error = curve[i] + z * slope[i];
        double right = 1 - error;
        if (right < LEAST) right = LEAST;
        else if (right > 1 - LEAST) right = 1 - LEAST;
        product *= right;
        if (product < 1e-200) {
          log += Math.log(product);
          product = 1;
        }
        y0 = x0;
        y1 = x1;
        y2 = x2;
        y3 = x3;
      }
      error *= rate;
      w[gate] = w0 + error * y0;
      w[gate + 1] = w1 + error * y1;
      w[gate + 2] = w2 + error * y2;
      w[gate + 3] = w3 + error * y3;
    }
    this.product = product;
  }

  /** Codes a word of n bytes and the space behind it, looking up a part of it at a time. keep: the frequent word to keep it for, or -1. */
  private void word(byte[] word, int n, int rank, int keep) {
    int sum = 0, power = 1;
    end = 0;
    for (int k = 0; k <= n; k++) {
      int c = k < n ? word[k] & 255 : SPACE;
      look(word, k, c, sum);
      sum += (c + 1) * power;
      power *= Hash.ODD;
      if (k == n && k < PART && keep >= 0 && end <= KEPT) model.known.set(keep, java.util.Arrays.copyOf(found, end));
      if (k % PART == PART - 1 || k == n) {
        code(found, end, rank);
        end = 0;
      }
    }
  }

  /** The natural logarithm of the probability of a text in UTF-8; of all: that, words, bytes, frequent words, the sum of their logarithms, other words. */
  public Object call(Object given) {
    if (all == null) open();
    System.arraycopy(model.start, 0, w, 0, w.length);
    log = 0;
    product = 1;
    int rank = 0;
    long words = 0, size = 0, frequent = 0;
    double logs = 0;
    java.util.ArrayList rare = new java.util.ArrayList();
    tokens.read((byte[]) given);
    while (tokens.next()) {
      int k = model.head.find(tokens.word, tokens.n, tokens.whole);
      int[] kept = k < 0 ? null : (int[]) model.known.get(k);
      if (kept != null) code(kept, kept.length, rank);
      else word(tokens.word, tokens.n, rank, k);
      int r = k < 0 ? model.common.find(tokens.word, tokens.n, tokens.whole) + 1 : model.headRank[k];
      if (r > 0) rank = r;
      words++;
      size += tokens.n + 1;
      if (k >= 0) {
        frequent++;
        logs += model.headLog[k];
      } else if (whole) rare.add(java.util.Arrays.copyOf(tokens.word, tokens.n));
    }
    end = 0;
    look(tokens.word, 0, END, 0);
    code(found, end, rank);
    Double score = Double.valueOf(log + Math.log(product));
    if (!whole) return score;
    return org.apache.spark.sql.RowFactory.create(new Object[] {score, Long.valueOf(words), Long.valueOf(size), Long.valueOf(frequent), Double.valueOf(logs), rare});
  }
}
"""


def _class(spark: SparkSession):
    """The compiled class; the archive is made and added where the session has none yet."""
    jvm = spark.sparkContext._jvm

    def find():
        for loader in (jvm.java.lang.Thread.currentThread().getContextClassLoader(), spark._jsparkSession.artifactManager().classloader()):
            try:
                return jvm.java.lang.Class.forName(CLASS, True, loader)
            except Exception as e:  # noqa: BLE001
                if "ClassNotFoundException" not in str(e):
                    raise
        return None

    found = find()
    if found is None:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE)
        made, archive = compiler.getBytecodes(), io.BytesIO()
        with zipfile.ZipFile(archive, "w") as z:
            for name in made.keySet():
                z.writestr(name.replace(".", "/") + ".class", bytes(made[name]))
        at = f"{common.shared_dir(spark).rstrip('/')}/loom-mixer-{uuid.uuid4().hex}.jar"
        path, files = common.folder(spark, at)
        out = files.create(path)
        out.write(archive.getvalue())
        out.close()
        files.deleteOnExit(path)
        spark.sql(f"ADD JAR '{at}'")
        found = find()
    return found


def _new(spark: SparkSession, name: str, *given):
    """An object of a class of the archive, by its only constructor."""
    cls = _class(spark).getClassLoader().loadClass(f"corpusloom.{name}")
    args = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.Object, len(given))
    for k, x in enumerate(given):
        args[k] = bytearray(x) if isinstance(x, bytes) else x
    maker = cls.getDeclaredConstructors()[0]
    maker.setAccessible(True)
    return maker.newInstance(args)


def sent(spark: SparkSession, model: bytes):
    """Bytes as a broadcast of the JVM, for the classes of the archive."""
    held = spark.sparkContext._jvm.java.io.ByteArrayOutputStream(len(model))
    for k in range(0, len(model), PIECE):
        held.writeBytes(bytearray(model[k : k + PIECE]))
    return _new(spark, "Sent", spark.sparkContext._jsc, held)


def _kind(spark: SparkSession, ddl: str):
    return spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromDDL(ddl)


def _mapped(df: DataFrame, schema: str, name: str, *given) -> DataFrame:
    """What a counter makes of the partitions of df."""
    spark = df.sparkSession
    kind = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.row(_kind(spark, f"struct<{schema}>"))
    return DataFrame(df._jdf.mapPartitions(_new(spark, name, *given), kind), spark)


def words_in(texts: DataFrame, most: int) -> DataFrame:
    """word, n over the only column of texts; a task holds at most so many words, and passes the same one on several times if there are more."""
    return _mapped(texts.select(F.col(texts.columns[0]).cast("binary")), "word: binary, n: bigint", "WordCounter", most)


def runs_in(texts: DataFrame, common_words: dict[bytes, int], most: int) -> DataFrame:
    """key, n of runs of bytes beside their common words, a task holding some `most` of them."""
    return _mapped(texts.select(F.col(texts.columns[0]).cast("binary")), "key: bigint, n: bigint", "RunCounter", most, listed(_ranked(common_words)))


def pairs_in(words: DataFrame) -> DataFrame:
    """pair, n of bytes that follow each other in words (word, n), the space before and behind among them; a null word is the end of a text."""
    return _mapped(words.select("word", "n"), "pair: int, n: bigint", "PairCounter")


def slots_in(rows: DataFrame, trees, order: int, bits: int, chunk: int) -> DataFrame:
    """part, sums of a table's slots from words (word, n; a null word is the end of a text), or from runs (key, n) if order is -1. trees: packed_trees, sent."""
    return _mapped(rows.select("word" if order >= 0 else "key", "n"), "part: int, sums: binary", "SlotCounter", trees, order, bits, chunk)


def _ints(x) -> bytes:
    return np.asarray(x, "<i4").tobytes()


def _ranked(common_words: dict[bytes, int]) -> list[bytes]:
    return sorted(common_words, key=common_words.get)


def listed(words) -> bytes:
    """Words as the classes read them."""
    return b"".join([_ints([len(words)]), *(x for w in words for x in (len(w).to_bytes(4, "little"), w))])


def packed_trees(trees) -> bytes:
    path = trees.nodes.astype(np.int64) << 1 | trees.bits.astype(np.int64)
    return b"".join([_ints(trees.start), _ints(trees.size), _ints([len(path)]), _ints(path)])


def packed(start: np.ndarray, rate: float, step: float, middle: int, trees, common_words: dict[bytes, int], tables: list[np.ndarray], head: dict[bytes, float] | None = None) -> bytes:
    """The model as the class reads it, all numbers little-endian. head: logarithms of frequent words."""
    parts = [_ints([start.shape[1], start.shape[0], middle]), np.array([rate, step, *start.ravel()], "<f8").tobytes(), packed_trees(trees), listed(_ranked(common_words))]
    parts += [x for t in tables for x in (_ints([len(t).bit_length() - 1]), t.tobytes())]
    return b"".join([*parts, listed(head or {}), np.array([*(head or {}).values()], "<f8").tobytes()])


def _registered(spark: SparkSession, model: bytes, whole: bool, kind: str) -> Callable[[Column], Column]:
    name = f"loom_mixer_{uuid.uuid4().hex}"
    spark._jsparkSession.udf().register(name, _new(spark, "Mixer", sent(spark, model), whole), _kind(spark, kind))
    return lambda text: F.call_function(name, F.coalesce(text, F.lit("")).cast("binary"))


def coder(spark: SparkSession, model: bytes) -> Callable[[Column], Column]:
    """A function of text: the natural logarithm of its probability under a packed model; null counts as empty."""
    return _registered(spark, model, False, "double")


def scorer(spark: SparkSession, model: bytes) -> Callable[[Column], Column]:
    """A function of text: that logarithm, and what the base score needs: words, their bytes with a space each, how many are in the head, the sum of their logarithms, and the other words."""
    return _registered(spark, model, True, "struct<log: double, n_words: bigint, n_bytes: bigint, n_head: bigint, head_log: double, rare: array<binary>>")

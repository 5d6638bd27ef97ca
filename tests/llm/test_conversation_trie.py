import hashlib
import random
import zlib

from pyspark.sql import functions as F

from notespark.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(talks):
    """Turns per conversation, in order; ties of a turn by the digest of role and text."""
    out = {}
    for c, turn, role, text in talks:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            halves = tuple(int.from_bytes(digest[k:k + 8], "big", signed=True) for k in (0, 8))
            out.setdefault(c, []).append(((turn is not None, turn or 0, *halves), (role, text)))
    return {c: [said for _, said in sorted(turns)] for c, turns in out.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(sequences):
    members, ends = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].encode().split()) if node else 0
        below = [total[k] for k in children.get(node, [])]
        total[node] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children.get(node, [])), *total[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items())


def rows(trie):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in trie.collect())


def table(spark, talks):
    return spark.createDataFrame(talks, SCHEMA)


def some_talks(seed=1, n=150):
    rnd = random.Random(seed)
    talks = []
    for c in rnd.sample(range(0, 300), n):
        for turn in range(rnd.choice([1, 1, 2, 3, 5])):
            talks.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["yes", "no way", "a b  c", ""])))
    rnd.shuffle(talks)
    return talks


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    talks = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(ct.op11_conversation_trie(spark, folder)) == brute(rebuilt(plain(talks)))


def test_many_shared_prefixes(spark):
    talks = some_talks()
    turns, convs = ct.shared_heads(ct.numbered(table(spark, talks).repartition(6)))
    want = brute(rebuilt(plain(talks)))
    assert len(want) > 80 and max(r[3] for r in want) == 150
    assert rows(ct.nodes(turns, convs)) == want


def test_nulls_ties_and_repeated_rows(spark):
    talks = [
        (0, None, "user", "first"), (0, 0, None, "second"), (0, 0, "user", None), (0, 0, "user", None), (20, 1, "user", "x" * 50_000),
        (1, 3, "user", "c"), (1, 3, "user", "c"), (1, 1, "assistant", "\x0b \t"), (None, 1, "user", "lost"), (-7, 0, "user", "neg"),
        (-7, 1, "user", "neg"), (-7, 2, "user", "neg"), (-7, 3, "user", "end"), (9_000_000_000, 1, "user", "wide")]
    turns, convs = ct.shared_heads(ct.numbered(table(spark, talks)))
    assert rows(ct.nodes(turns, convs)) == brute(rebuilt(plain(talks)))


def test_conversations_without_turns_end_at_the_root(spark):
    lost = [c for c in range(1000, 1400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:9]
    talks = [(c, 0, "user", "gone") for c in lost]
    turns, convs = ct.shared_heads(ct.numbered(table(spark, talks)))
    got = rows(ct.nodes(turns, convs))
    assert got == brute(rebuilt(plain(talks)))
    assert got == [(min(lost), 0, -1, 9, 0, 1, 0, hashlib.sha256(",".join(map(str, lost)).encode()).hexdigest())]


def test_a_large_group_of_copies_and_a_long_conversation(spark, monkeypatch):
    talks = [(c, k, "user", f"turn {k}") for c in range(400) for k in range(3)]
    talks += [(1001, k, "user", f"w{k % 7} more") for k in range(1500)]
    monkeypatch.setattr(ct, "PIECE", 50)
    sequences = plain(talks)
    turns = ct.numbered(table(spark, talks).repartition(8))
    convs = turns.select("conv_id").distinct()
    assert ct.sequences(turns, convs).count() == 2
    assert rows(ct.nodes(turns, convs)) == brute(sequences)


def test_texts_of_nodes_and_other_columns(spark):
    talks = table(spark, some_talks(2, 40)).withColumn("pos", F.lit("clash")).withColumn("_range", F.lit(1)).withColumn("d1", F.lit(0))
    turns, convs = ct.shared_heads(ct.numbered(talks, keep=["role", "text"]))
    trie = ct.nodes(turns, convs)
    out = ct.with_turns(trie, turns)
    assert out.count() == trie.count() == len(brute(rebuilt(plain([tuple(r)[:4] for r in talks.collect()]))))
    assert out.where("depth > 0 AND text IS NULL").count() == 0


def test_an_empty_table(spark):
    turns, convs = ct.shared_heads(ct.numbered(table(spark, [])))
    assert ct.nodes(turns, convs).count() == 0

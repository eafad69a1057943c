from collections import defaultdict

import xxhash
from fixtures import odd_documents, odd_rows

from tallyglass.llm import sharding as S


def brute(keys, ring):
    """Every key asks the shards clockwise; in each round the shards take askers in ring order while there is room."""
    points, walks, room = ring.points(), ring.walks(), ring.limits(len(keys))
    place = {k: xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42) for k in keys}
    asking, out = sorted(keys, key=lambda k: (place[k] >> (64 - ring.cell_bits), (place[k] ^ (1 << 63)), k)), {}
    for step in range(ring.shards):
        left = []
        for k in asking:
            cell = place[k] >> (64 - ring.cell_bits)
            node = next((i for i, (c, _) in enumerate(points) if c >= cell), 0)
            shard = walks[node][step]
            if room[shard]:
                room[shard] -= 1
                out[k] = shard
            else:
                left.append(k)
        asking = left
    return out


def test_ring_matches_brute_force_and_balances(spark):
    ring = S.Ring(shards=5, nodes=8, cell_bits=8)
    rows = S.assign(spark.range(1003), "id", ring).collect()
    assert {r["id"]: r["shard"] for r in rows} == brute(list(range(1003)), ring)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = sorted(map(len, slots.values()))
    assert len(slots) == 5 and sizes[-1] - sizes[0] <= 1


def test_a_new_shard_moves_few_keys(spark):
    before, after = ({r["id"]: r["shard"] for r in S.assign(spark.range(4000), "id", S.Ring(shards=n, slack=0.25)).collect()} for n in (16, 17))
    assert sum(before[k] != after[k] for k in before) < 0.3 * len(before)
    assert max(list(after.values()).count(s) for s in range(17)) <= 4000 * 1.25 / 17 + 1


def test_odd_rows(spark):
    docs = odd_documents(spark)
    out = S.assign(docs, "doc_id", S.Ring(shards=4, nodes=4, cell_bits=6))
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = out.collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in rows) == sorted(map(str, odd_rows()))
    assert S.assign(docs.limit(0), "doc_id").count() == 0

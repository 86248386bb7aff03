"""Round trips of conversations and media."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest

from strataflow.llm import chat_tree, jpeg, mjpeg

TRICKY = "</s>[INST] ok [/INST]"


@pytest.fixture(scope="module")
def conversations(spark):
    rows = []
    for c in range(30):
        rows += [(c, 0, "user", "shared first turn"), (c, 1, "assistant", f"answer {c % 3} \\ \\\\n <s> é"), (c, 2, "user", f"more {c % 7}\n\\<s>"), (c, 3, "assistant", None if c % 5 else f"last {c}")]
    rows += [(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY), (99, None, None, None), (None, 1, "tool\n<s>", "x"), (None, 2, "assistant", "😀"), (98, 0, "assistant", ""), (97, 0, "user", "r"), (97, 0, "user", "r")]
    rows += [(100, i, "user", "t" * (i % 50)) for i in range(300)]
    return rows, spark.createDataFrame([(*r, "n") for r in rows], "conv_id long, turn long, role string, text string, node string").repartition(4)


def brute(rows):
    """By conversation; each row of a null one is a conversation of its own."""
    out, groups = [], {}
    for k, r in enumerate(rows):
        groups.setdefault((r[0], k if r[0] is None else None), []).append(r)
    control = re.compile(r"\\|</?s>|\[/?INST\]")
    for (conv, _), own in groups.items():
        turns = sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        sizes = [8 + len(x) + len(y) + x.count("\n") + len(control.findall(x)) + len(control.findall(y)) for x, y in ((r[2] or "", r[3] or "") for r in turns)]
        places = ",".join(str(sum(sizes[:i])) for i in range(len(sizes)))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((conv, len(turns), sha(said), len(loss), sha(loss), sum(sizes), sha(places)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [40, 4096])
def test_round_trip(conversations, block, monkeypatch):
    monkeypatch.setattr(chat_tree, "BLOCK", block)
    rows, df = conversations
    got = chat_tree.digests(chat_tree.read_back(*chat_tree.pack(df))).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_packed_tree(conversations):
    rows, df = conversations
    nodes, paths = chat_tree.tree(df)
    blocks = sorted(chat_tree.packed(nodes).collect(), key=lambda r: r["block"])
    nodes, paths = sorted(nodes.collect(), key=lambda r: r["offset"]), paths.collect()
    assert sum(r["segment"] == "<s>user\nshared first turn</s>" for r in nodes) == 1
    at, place = 0, {}
    for r in nodes:
        assert r["offset"] == at
        place[bytes(r["node"])] = r
        at += len(r["segment"])
    stack = []
    for r in nodes:  # depth first: each node's parent is open
        stack = stack[: r["depth"]]
        assert len(stack) == r["depth"] and (bytes(r["parent"]) == stack[-1] if stack else r["parent"] is None)
        assert r["position"] == (place[stack[-1]]["position"] + len(place[stack[-1]]["segment"]) if stack else 0)
        stack.append(bytes(r["node"]))
    text = "".join(r["segment"] for r in nodes)
    assert "".join(r["text"] for r in blocks) == text and [r["block"] for r in blocks] == list(range(len(blocks)))
    assert {r["block"] * 4096 + s["at"]: s["position"] for r in blocks for s in r["starts"]} == {r["offset"]: r["position"] for r in nodes}
    assert "".join(r["mask"] for r in blocks).count("1") == sum(r["text_chars"] for r in nodes if r["loss"])
    ends = {r["offset"] + len(r["segment"]) for r in nodes}
    for p in paths:
        assert all(a["end"] < b["offset"] for a, b in zip(p["attends"], p["attends"][1:])) and all(a["end"] in ends for a in p["attends"])


def test_a_long_turn(spark):
    """A turn over many blocks, and a conversation of many turns."""
    rows = [(1, 0, "user", "x\\<s>" * 50_000), (1, 1, "assistant", "é" * 9000), *((2, i, "assistant", f"t{i}") for i in range(5000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in chat_tree.digests(chat_tree.read_back(*chat_tree.pack(df))).collect()), key=str) == brute(rows)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_tree.digests(chat_tree.read_back(*chat_tree.pack(none))).count() == 0


def test_media_round_trip(docs, texts):
    decoded = mjpeg.decode(mjpeg.encode(docs, batch_bytes=3000), batch_bytes=5000)
    rows = {r["doc_id"]: r for r in mjpeg.digests(decoded).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        padded = b + b"\xff" * (-len(b) % 576 if b else 576)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(b), len(padded), hashlib.sha256(padded).hexdigest())
    shots = mjpeg.clips(decoded).groupBy("doc_id").count().count()
    assert shots == len(texts)


def test_all_byte_values_and_damage(spark):
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, 256, 576 * 3), np.tile([0, 255], 288), np.zeros(576), np.full(576, 255)]).astype(np.uint8)
    frames = [mjpeg.HEADER + s + b"\xff\xd9" for s in mjpeg.scans(data)]
    file = mjpeg.avi(frames)
    assert mjpeg.frames_of(file) == (frames, 1 / 24)
    values, good = mjpeg.samples(b"".join(mjpeg._scan_of(f) for f in frames))
    assert values.tobytes() == data.tobytes() and good.all()
    # A block's value is that of all its pixels, to the general decoder too.
    assert (jpeg.grey_values(frames[0]) == np.kron(data[:576].reshape(24, 24), np.ones((8, 8), dtype=np.uint8))).all()
    flipped = [bytearray(file) for _ in range(3)]
    at = file.index(frames[1]) + len(mjpeg.HEADER)
    flipped[0][at + 5 : at + 10] = b"\xfe\xfe\xfe\xfe\xfe"
    flipped[1][at : at + 40] = b"\x00" * 40
    flipped[2][file.index(frames[0]) + 30] ^= 0xFF
    rows = [(1, 1, bytearray(file)), (2, 1, bytearray(file[:50])), (3, 1, None), (4, 1, bytearray(b"RIFF")), *((5 + i, 1, f) for i, f in enumerate(flipped)), (9, 1, bytearray(file))]
    broken = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").coalesce(1)
    got = {r["doc_id"]: (r["payload"] and bytes(r["payload"]), r["error"]) for r in mjpeg.decode(broken).collect()}
    assert got[1] == got[9] == (data.tobytes(), None) and all(got[i][0] is None and got[i][1] for i in (2, 3, 4, 5, 6))


def coded(height, width, sampling, seed, restart=0, header_tables=True):
    """A JPEG frame of random coefficients, by a plain encoder, and the grey values that it stands for."""
    rng = np.random.default_rng(seed)
    tables = jpeg.standard_tables()
    codes = {}
    for key, (counts, symbols) in tables.items():
        code, at = 0, 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                codes[key, symbols[at]] = format(code, f"0{length}b")
                code, at = code + 1, at + 1
            code <<= 1
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    down, across = -(-height // (8 * high)), -(-width // (8 * wide))
    quantiser = rng.integers(1, 30, 64)
    number = lambda x: "" if not x else format(x if x > 0 else x + (1 << abs(x).bit_length()) - 1, f"0{abs(x).bit_length()}b")
    plane = np.zeros((down * high * 8, across * wide * 8))
    bits, before, parts, n = "", [0] * len(sampling), [], 0

    def flush():
        raw = int((bits + "1" * (-len(bits) % 8)) or "0", 2).to_bytes((len(bits) + 7) // 8, "big")
        parts.append(raw.replace(b"\xff", b"\xff\x00"))

    for y in range(down):
        for x in range(across):
            if restart and n and n % restart == 0:
                flush()
                bits, before = "", [0] * len(sampling)
            n += 1
            for c, (h, v) in enumerate(sampling):
                for j in range(v):
                    for i in range(h):
                        block = np.zeros(64, dtype=int)
                        block[0] = rng.integers(-60, 60)
                        for k in rng.choice(np.arange(1, 64), rng.integers(0, 12), replace=False):
                            block[k] = rng.integers(-9, 10)
                        diff = int(block[0]) - before[c]
                        before[c] = int(block[0])
                        bits += codes[(0, min(c, 1)), abs(diff).bit_length()] + number(diff)
                        run = 0
                        for k in range(1, 64):
                            if not block[k]:
                                run += 1
                                continue
                            while run > 15:
                                bits += codes[(1, min(c, 1)), 0xF0]
                                run -= 16
                            bits += codes[(1, min(c, 1)), run << 4 | abs(int(block[k])).bit_length()] + number(int(block[k]))
                            run = 0
                        if run:
                            bits += codes[(1, min(c, 1)), 0]
                        if c == 0:
                            natural = np.zeros((8, 8))
                            for k in range(64):
                                natural.flat[jpeg.ZIGZAG[k]] = block[k] * quantiser[k]
                            basis = lambda u, p: (np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * p + 1) * u * np.pi / 16)
                            b = np.array([[basis(u, p) for p in range(8)] for u in range(8)])
                            plane[(y * high + j) * 8 : (y * high + j) * 8 + 8, (x * wide + i) * 8 : (x * wide + i) * 8 + 8] = np.einsum("uv,up,vq->pq", natural, b, b)
    flush()
    seg = mjpeg._segment
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\x00") + seg(0xDB, b"\x00" + bytes(quantiser.tolist()))
    out += seg(0xC0, bytes([8, height >> 8, height & 255, width >> 8, width & 255, len(sampling)]) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling)))
    if header_tables:
        out += seg(0xC4, b"".join(bytes([k << 4 | i]) + tables[k, i][0] + tables[k, i][1] for k, i in tables))
    if restart:
        out += seg(0xDD, bytes([restart >> 8, restart & 255]))
    out += seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([c + 1, 0x11 * min(c, 1)]) for c in range(len(sampling))) + bytes([0, 63, 0]))
    for i, p in enumerate(parts):
        out += (bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + p
    return out + b"\xff\xd9", np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[:height, :width]


def test_zigzag():
    assert jpeg.ZIGZAG[:12] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25] and jpeg.ZIGZAG[-3:] == [55, 62, 63] and sorted(jpeg.ZIGZAG) == list(range(64))


@pytest.mark.parametrize(("shape", "sampling", "restart", "tables"), [((16, 24), [(1, 1)], 0, True), ((40, 50), [(2, 2), (1, 1), (1, 1)], 0, False), ((33, 70), [(2, 1), (1, 1), (1, 1)], 3, True), ((8, 8), [(2, 2)], 0, True)])
def test_frames_of_other_makers(shape, sampling, restart, tables):
    frame, want = coded(*shape, sampling if len(sampling) > 1 else [(1, 1)], 7, restart, tables)
    assert np.abs(jpeg.grey_values(frame).astype(int) - want).max() <= 1
    with pytest.raises((ValueError, IndexError)):
        jpeg.grey_values(frame[: len(frame) // 2])
    with pytest.raises(ValueError):
        jpeg.grey_values(frame.replace(b"\xff\xc0", b"\xff\xc2"))


def test_file_of_another_maker(spark):
    """Colour frames with 4:2:0 sampling; the scene changes after the first frame and after the fourth."""
    made = [coded(32, 48, [(2, 2), (1, 1), (1, 1)], seed) for seed in (1, 2, 3)]
    order = [0, 1, 1, 1, 2, 2]
    file = mjpeg.avi([made[i][0] for i in order])
    row = mjpeg.decode(spark.createDataFrame([(1, 0, bytearray(file))], "doc_id long, n_bytes long, media binary")).first()
    assert row["error"] is None and row["n_frames"] == 6
    assert np.abs(np.frombuffer(bytes(row["payload"]), dtype=np.uint8).reshape(6, 32, 48).astype(int) - np.stack([made[i][1] for i in order])).max() <= 1
    assert [(s["first"], s["last"]) for s in row["shots"]] == [(0, 0), (1, 3), (4, 5)] and row["shots"][1]["start_s"] == pytest.approx(1 / 24)


def test_changed_files_are_errors_of_their_own(spark):
    """Wrong sampling factors, nested lists and changed fields of the headers: no other file suffers."""
    frame, want = coded(32, 48, [(2, 2), (1, 1), (1, 1)], 1)
    good = mjpeg.avi([frame])
    size = frame.index(b"\xff\xc0") + 11  # the first component's sampling
    files = [good, mjpeg.avi([frame[:size] + b"\x00" + frame[size + 1 :]]), mjpeg.avi([frame[:size] + b"\xff" + frame[size + 1 :]])]
    nested = b""
    for _ in range(3000):
        nested = b"LIST" + struct.pack("<I", len(nested) + 4) + b"strl" + nested
    at = good.index(b"hdrl") + 4
    files.append(good[:at] + nested + good[at:])
    rng = random.Random(8)
    for _ in range(400):
        changed = bytearray(good)
        fields = [good.index(x) + rng.randrange(24) for x in rng.choices([b"\xff\xc0", b"\xff\xdb", b"\xff\xda", b"strh", b"idx1", b"movi", b"hdrl", b"avih"], k=2)]
        for i in fields:
            changed[min(i, len(good) - 1)] = rng.choice([0, 1, 0x0F, 0x10, 0x7F, 0xFF, rng.randrange(256)])
        files.append(bytes(changed))
    rows = {r["doc_id"]: r for r in mjpeg.decode(spark.createDataFrame([(i, 0, bytearray(f)) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary")).collect()}
    assert len(rows) == len(files) and all((r["payload"] is None) == (r["error"] is not None) for r in rows.values())
    assert rows[0]["error"] is None and rows[1]["error"] and rows[2]["error"]


def test_query_columns_against_brute_force(docs, texts):
    files = {r["doc_id"]: bytes(r["media"]) for r in mjpeg.encode(docs).collect()}
    rows = {r["doc_id"]: r for r in mjpeg.digests(mjpeg.decode(mjpeg.encode(docs))).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        padded = b + b"\xff" * (-len(b) % 576 if b else 576)
        r, blocks = rows[i], [padded[k : k + 576] for k in range(0, len(padded), 576)]
        assert r["tail_crc32"] == zlib.crc32(padded[-32:]) and (r["media_bytes"], r["media_sha256"]) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
        hist = [[sum(x >> 4 == k for x in b) / 576 for k in range(16)] for b in blocks]
        starts, recent = [0], []
        for k in range(1, len(blocks)):
            d = sum(abs(x - y) for x, y in zip(hist[k], hist[k - 1], strict=True)) / 2
            mean = sum(recent) / len(recent) if recent else 0
            cut = d > 0.1 and (not recent or d > mean + 2 * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 + 1e-9)
            starts, recent = ([*starts, k], recent) if cut else (starts, [*recent, d][-8:])
        times = ",".join(f"{a / 24:.3f}-{z / 24:.3f}" for a, z in zip(starts, [*starts[1:], len(blocks)], strict=True))
        assert (r["feature"], r["n_clips"]) == (f"{len(blocks)} frames, clips {times}", len(starts))


def test_shots():
    hist = np.zeros((20, 16), dtype=np.int64)
    hist[:8, 1] = hist[8:15, 9] = hist[15:, 3] = 1
    assert mjpeg.shot_starts(hist) == [0, 8, 15]
    assert mjpeg.shot_starts(hist[7:9]) == [0, 1] and mjpeg.shot_starts(hist[[0, 0, 9, 9, 0, 0, 9, 9]]) == [0, 2, 4, 6]


def test_no_documents(no_docs, odd_docs):
    assert mjpeg.digests(mjpeg.decode(mjpeg.encode(no_docs))).count() == 0
    assert mjpeg.digests(mjpeg.decode(mjpeg.encode(odd_docs))).count() == 5

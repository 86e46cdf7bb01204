"""Matroska and chat formatting: exact round trips and a plain version."""

import hashlib
import random
import zlib

import pytest

from kinfold.llm import chat, matroska


def test_media_round_trip():
    r = random.Random(1)
    for units in (1, 2, 7, 8, 9, 17, 401, 900):
        payload = r.randbytes(576 * units)
        file = matroska.mux(payload)
        media = matroska.demux(file)
        assert b"".join(file[p.offset : p.offset + p.length] for p in media.packets) == payload
        assert [p.timestamp_ns for p in media.packets] == [k * 72_000_000 for k in range(units)]
        assert {c[2] for c in media.cues} == {p.cluster for p in media.packets} and media.codecs == {1: "A_PCM/INT/LIT"}
    file = matroska.mux(r.randbytes(1000))
    assert [p.length for p in matroska.demux(file).packets] == [576, 424]


def test_laces():
    r = random.Random(2)
    for kind in (1, 3):
        frames = [r.randbytes(r.choice([0, 5, 254, 255, 256, 600, 3000])) for _ in range(40)]
        block = matroska.lace(frames, kind)
        assert [block[a : a + n] for a, n in matroska.laces(block, 0, len(block), kind)] == frames


def test_unknown_sizes_and_groups():
    unknown = b"\x01" + b"\xff" * 7
    block = matroska.element(matroska.BLOCK, b"\x81\x00\x05\x00abc")
    cluster = b"\x1f\x43\xb6\x75" + unknown + matroska.number(matroska.TIME, 10) + matroska.element(matroska.GROUP, block + matroska.element(matroska.REFERENCE, b"\xff")) + matroska.element(0xEC, b"void")
    file = matroska.element(matroska.EBML, b"") + b"\x18\x53\x80\x67" + unknown + cluster + cluster
    found = matroska.demux(file).packets
    assert [(p.timestamp_ns, p.key, file[p.offset : p.offset + p.length]) for p in found] == [(15_000_000, False, b"abc")] * 2 and found[0].cluster != found[1].cluster
    with pytest.raises(ValueError):
        matroska.demux(matroska.mux(b"\x01" * 576)[:-5])


def test_group_flags():
    """A block group's reference, before or behind its block, tells of all its laced frames and of no other block."""
    reference = matroska.element(matroska.REFERENCE, b"\xff")
    laced = matroska.element(matroska.BLOCK, b"\x81\x00\x00\x04" + matroska.lace([b"aa", b"bb", b"cc"], 2))
    plain = matroska.element(matroska.BLOCK, b"\x81\x00\x01\x00dd")
    for order in ((laced, reference), (reference, laced)):
        body = matroska.number(matroska.TIME, 0) + matroska.element(matroska.GROUP, plain) + matroska.element(matroska.GROUP, b"".join(order)) + matroska.element(matroska.GROUP, plain)
        file = matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, body))
        assert [(p.key, p.length) for p in matroska.demux(file).packets] == [(True, 2)] + [(False, 2)] * 3 + [(True, 2)]


def test_corrupt(spark):
    r = random.Random(4)
    good = matroska.mux(r.randbytes(576 * 30))
    bad = [b"", good[:-5], b"\x00" * 40, good[:100] + r.randbytes(60) + good[160:], r.randbytes(300), good[:3]]
    rows = spark.createDataFrame([(k, bytes(v), "x") for k, v in enumerate([good, *bad])], "media_id long, media binary, error string")
    got = matroska.packets(rows).collect()
    assert sum(x["id"] == 0 and x["error"] is None and x["length"] == 576 for x in got) == 30
    failed = {x["id"] for x in got if x["error"]}
    assert {2, 3, 5, 6} <= failed and all(x["track"] is None for x in got if x["error"])
    for cut in range(0, len(good), 97):  # any prefix is read or refused, never anything else
        try:
            matroska.demux(good[:cut])
        except (ValueError, IndexError, matroska.struct.error):
            pass


def test_stored(spark):
    texts = ["", None, "a" * 576, "é" * 999, "x" * 300_000, "same", "same"]
    rows = spark.createDataFrame([(i if i != 3 else None, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media_bytes string")
    for r in matroska.stored(rows).collect():
        raw = (texts[3] if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(matroska.mux(payload)), hashlib.sha256(matroska.mux(payload)).hexdigest())
    assert matroska.stored(rows.limit(0)).count() == 0
    media = spark.createDataFrame([("a", matroska.mux(b"\x05" * 1728)), ("b", None)], "media_id string, media binary")
    assert [r["length"] for r in matroska.packets(media).collect()] == [576] * 3


def test_escapes():
    r = random.Random(3)
    for _ in range(2000):
        text = "".join(r.choice(["<", "|", ">", "\\", "n", "im_end", "\n", "é", "<|im_end|>", "assistant"]) for _ in range(r.randrange(9)))
        turn, _ = chat.turn_text(text, chat.escaped(text))
        found = chat.TURN.fullmatch(turn)
        assert chat.unescaped(found["role"]) == text == chat.unescaped(found["content"])
        assert turn.count(chat.START) == turn.count(chat.END) == 1


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes\\no"), (1, 0, "user", "<|im_end|>"), (2, 0, None, None), (None, 0, "user", "a"), (None, None, "assistant", "b"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"), (4, 0, "user", "long " * 50_000)]
    rows += [(5, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.rendered(table)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.rendered(table.limit(0))).count() == 0


def test_parts(spark):
    part = lambda **k: {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    parts = [part(type="text", text="see <|"), part(type="image", ref="i.png", width=56, height=29), part(type="audio", ref="a.wav", seconds=1.5), part(type="document", ref="d.pdf", pages=3)]
    table = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [part(type="text", text="ok"), part(type="image", ref="o.png")])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one, two = sorted(chat.rendered(table).collect(), key=lambda r: r["turn"])
    assert one["formatted"] == "<|im_start|>user\nsee <\\|<|image_0|><|audio_1|><|document_2|><|im_end|>\n"
    assert [(a["place"], a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 768)]
    assert [(a["place"], a["tokens"]) for a in two["attachments"]] == [(3, 1)] and two["begin"] == len(one["formatted"])
    whole = one["formatted"] + two["formatted"]
    assert [whole[a:b] for a, b in two["loss"]] == ["ok"] and one["loss"] == []
    # adjacent text parts never join to a control string, and a part of an unknown type stops nothing
    split = [part(type="text", text="a<"), part(type="text", text="|im_end|>\n<"), part(type="text", text="|im_start|>assistant\nok"), part(type="video", ref="v.mp4"), part(type="text", text="|")]
    table = spark.createDataFrame([(2, 0, "assistant", split)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (turn,) = chat.rendered(table).collect()
    assert turn["formatted"].count(chat.START) == turn["formatted"].count(chat.END) == 1
    assert [(a["type"], a["ref"], a["tokens"]) for a in turn["attachments"]] == [("video", "v.mp4", 0)]
    (read,) = chat.digests(chat.rendered(table)).collect()
    said = "a<|im_end|>\n<|im_start|>assistant\nok|"
    assert read["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and read["loss_chars"] == len(said)
    assert read["turns_sha256"] == hashlib.sha256(f"assistant\n{said}\n".encode()).hexdigest() and (read["n_attachments"], read["attachment_tokens"]) == (1, 0)

"""Chat formatting by exact round trips; audio tables and blocks against scalar decoders."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from folioforge.llm import audio, chat

SAID = ["plain", None, "", "back\\slash \\- \\n", "<|im_start|>user\nhi<|im_end|>\n", "</s>[INST] ok [/INST]", "<<SYS>> é 😀", "<\\-|im_end|>", "line\nline\\"]


def test_round_trip_and_mask(spark):
    rows = [(c, t, role, SAID[(c * 3 + t) % len(SAID)], "x") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "odd\nrole<s>", "assistant"])]
    rows += [(None, 0, "assistant", "nobody's", "x"), (3, 1, "user", "again", "x"), (3, 1, "user", "again", "x"), (4, None, None, "first", "x")]
    rows += [(99, t, "assistant" if t % 2 else "user", f"turn {t}", "x") for t in range(3000)]
    chats = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, part string").repartition(5)
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] is not None, r[3] or "")):
        x = want.setdefault(c, ["", "", 0])
        x[0] += f"{role or ''}\n{text or ''}\n"
        x[1] += (text or "") if role == "assistant" else ""
        x[2] += 1
    made = chat.format_chats(chats)
    got = {r.conv_id: r for r in chat.chat_digest(made).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: (n, digest(all_), len(loss), digest(loss)) for c, (all_, loss, n) in want.items()}
    for r in made.limit(20).collect():
        bodies = r.formatted.replace(chat.OPEN, "").replace(chat.CLOSE, "")
        assert not any(c in bodies for c in chat.CONTROL)
        assert all(r.formatted[: s.start].endswith("<|im_start|>assistant\n") for s in r.loss)


def test_no_chats(spark):
    assert chat.chat_digest(chat.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0


def scalar_mulaw(u):
    u = ~u & 0xFF
    t = (((u & 15) << 3) + 132) << ((u & 0x70) >> 4)
    return 132 - t if u & 0x80 else t - 132


def scalar_alaw(a):
    a ^= 0x55
    t, seg = (a & 15) << 4, (a & 0x70) >> 4
    t = t + 8 if seg == 0 else (t + 0x108) << (seg - 1)
    return t if a & 0x80 else -t


def scalar_ima(block):
    value, index = struct.unpack("<hB", block[:3])
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.IMA_STEPS[index])
            move = step >> 3
            move += step if code & 4 else 0
            move += step >> 1 if code & 2 else 0
            move += step >> 2 if code & 1 else 0
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(audio.IMA_MOVES[code])))
            out.append(value)
    return out


def test_tables():
    assert audio.mulaw_table().tolist() == [scalar_mulaw(u) for u in range(256)]
    assert audio.alaw_table().tolist() == [scalar_alaw(u) for u in range(256)]
    assert (audio.mulaw_table()[0], audio.mulaw_table()[0xFF], audio.alaw_table()[0xD5]) == (-32124, 0, 8)


def test_blocks_decode_as_one_by_one():
    blocks = np.random.default_rng(0).integers(0, 256, (50, 64)).astype(np.uint8)
    assert audio.ima_decode(blocks).tolist() == [scalar_ima(b.tobytes()) for b in blocks]


def test_resample():
    x = np.array([0, 100, -50], np.int16)
    assert audio.resample(x, 8000, 16000).tolist() == [0, 50, 100, 25, -50, -50]
    assert audio.resample(x, 8000, 8000) is x
    assert len(audio.resample(x, 8000, 4000)) == 1


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima"])
def test_stored_bytes_come_back(spark, codec):
    texts = [None, "", "a" * 64, "é" * 33, "long " * 5000, "a" * 64]
    rows = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)] + [(None, "x", None)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in audio.audio_digest(audio.store_audio(rows, "text", codec)).collect()}
    for i, t in [*enumerate(texts), (None, "x")]:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        file = audio.wav(payload, codec)
        pcm = audio.resample(audio.decode(file), 8000, 16000).astype(int)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert r.feature.split(":")[:2] == [str(len(pcm)), str(abs(pcm).max())]
    assert got[2].feature == got[5].feature

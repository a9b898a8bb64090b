import pytest

from quarry.errors import CompressionError, ProtocolError
from quarry.operators.cityhash import city_hash128
from quarry.operators.compression import compress_frame, compress_frames, decompress_frame, decompress_stream, frame_header
from quarry.plans import protocol as p


def test_hash_vectors():
    assert city_hash128(b"") == (0x3DF09DFC64C09A2B, 0x3CB540C392E51E29)
    assert city_hash128(b"a") == (0xD27139A1AFE01AD0, 0xFD7E8EE2E4C86CF6)
    assert city_hash128(b"abc") == (0x900FF195577748FE, 0x13A9176355B20D7E)
    assert len({city_hash128(bytes(range(256)) * k) for k in range(1, 8)}) == 7


def test_known_frame():
    known = bytes.fromhex("a783ac6cd55c7a7cb5ac46bddb86e21482140000000a000000a0010002ffffffff000000")
    assert compress_frame(p.EMPTY_BLOCK) == known and decompress_frame(known) == (p.EMPTY_BLOCK, len(known))


@pytest.mark.parametrize("method", ["none", "lz4", "zstd"])
def test_frames(method):
    plain = bytes(range(256)) * 40
    frames = compress_frames(plain, method, 1000)
    assert decompress_stream(frames) == plain
    assert frame_header(frames).plain == 1000
    for spoiled in (frames[:30], b"\1" + frames[1:], frames[:16] + b"\x77" + frames[17:], frames[:21] + b"\0\0\0\0" + frames[25:]):
        with pytest.raises(CompressionError):
            decompress_stream(spoiled)
    decompress_frame(b"\1" + frames[1:], verify=False)


def ready(**more):
    c = p.Connection(**more)
    assert c.take_output()[0] == p.CLIENT_HELLO
    c.feed(p.server_hello())
    assert c.poll_event().kind == "hello" and c.take_output() == b"\0"
    return c


def test_select_in_any_pieces():
    packets = p.server_progress(1, 2, 3, 4, 5, 6) + p.server_block(p.DATA, p.EMPTY_BLOCK, True) + p.server_profile_info(1, 1, 8, True, 9) + p.varint(p.END_OF_STREAM)
    for piece in (1, 3, 1000):
        c = ready(compressed=True)
        c.query(p.Query("SELECT 1", settings={"a": 1}, parameters={"x": "it's"}))
        for at in range(0, len(packets), piece):
            c.feed(packets[at : at + piece])
        kinds = []
        while (e := c.poll_event()) is not None:
            kinds.append(e.kind)
        assert kinds == ["progress", "profile_info", "end_of_stream"] and c.state == p.State.READY


def test_misuse():
    c = p.Connection()
    with pytest.raises(ProtocolError):
        c.query(p.Query("SELECT 1"))
    c = ready()
    with pytest.raises(ProtocolError):
        c.feed(p.varint(p.PONG))
    assert c.state == p.State.FAILED
    c = ready()
    c.ping()
    c.feed(p.varint(p.PONG))
    assert c.poll_event().kind == "pong"
    c.query(p.Query("SELECT 1"))
    c.feed(p.server_exception(60, "E", "no table"))
    assert c.poll_event().fields["code"] == 60 and c.state == p.State.READY
    c.query(p.Query("SELECT 1"))
    with pytest.raises(ProtocolError):
        c.finish()


def test_insert():
    c = ready()
    c.insert(p.Query("INSERT INTO t VALUES"))
    c.feed(p.server_block(p.DATA, bytes.fromhex("010002ffffffff000100016e05496e743332") + b"\0"))
    assert c.poll_event().kind == "insert_schema" and c.state == p.State.INSERTING
    with pytest.raises(ProtocolError):
        c.insert_data(p.EMPTY_BLOCK)
    c.finish_insert()
    c.feed(p.varint(p.END_OF_STREAM))
    assert c.state == p.State.READY


@pytest.mark.parametrize("compressed", [False, True])
def test_packets_in_pieces(compressed):
    block = p.EMPTY_BLOCK
    from quarry.functions.types import parse
    from quarry.operators.blocks import write_block
    from quarry.operators.columns import Options
    import pyarrow as pa

    texts = [f"row {i} " * (i % 7) for i in range(3000)]
    block = write_block(pa.RecordBatch.from_arrays([pa.array(texts)], names=["x"]), [("x", parse("String"))], Options(revision=p.REVISION))
    body = compress_frames(block, "lz4", 4096) if compressed else block
    sent = p.server_hello() + b"".join([p.varint(p.DATA) + p.string("") + body, p.server_progress(1, 2, 3, 4, 5, 6)] * 2)
    for piece in (1, 61, 5000, len(sent)):
        c = p.Connection(compressed=compressed)
        hello = len(p.server_hello())
        c.feed(sent[:hello])
        c.query(p.Query("SELECT x"))
        for at in range(hello, len(sent), piece):
            c.feed(sent[at : at + piece])
        events = []
        while (e := c.poll_event()) is not None:
            events.append(e)
        assert [e.kind for e in events] == ["hello", "data", "progress", "data", "progress"]
        assert events[1].block == events[3].block == block


def test_first_answers_after_settings_fail_closed():
    for settings, answered, usable in ((False, False, True), (True, False, False), (True, True, True)):
        c = p.Connection()
        c.feed(p.server_hello())
        c.query(p.Query("SELECT 1", settings={"a": "1"} if settings else {}))
        if answered:
            c.feed(p.server_progress(1, 2, 3, 4, 5, 6))
        c.feed(p.server_exception(115, "E", "unknown setting"))
        assert c.state == (p.State.READY if usable else p.State.FAILED)

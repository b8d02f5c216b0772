"""The way through a frame record, with codebooks made up for the test."""

import numpy as np
import pytest

from hopframe.operators import codec, framing, lpc, transform
from hopframe.plans import audio, convert, modes
from hopframe.sources import container, wav


_books = audio.made_up_books


@pytest.mark.parametrize("mode", [m[:2] for m in modes.MODES])
@pytest.mark.parametrize("channels", [1, 2])
def test_records_round_trip(mode, channels):
    layout = codec.Layout(*mode, channels)
    rng = np.random.default_rng(1)
    for kind in range(9):
        codes = [kind, *(int(rng.integers(2**bits)) for _, bits in layout.fields(codec.TYPE_OF_WINDOW[kind]))]
        data = layout.pack(codes)
        assert layout.parse(data) == codes and len(data) == -(-layout.frame_bits // 8)
        shifted = (int.from_bytes(data, "big") << 3).to_bytes(len(data) + 1, "big")
        assert layout.parse(shifted, 5) == codes
    assert layout.parse(b"\xf0" + b"\0" * 999) is None


def test_layouts_are_the_bit_plans(spark):
    rows = {(r.rate_class, r.kbps_ch, r.ch, r.ftype): r for r in modes.bit_plan(spark).collect()}
    targets = {}
    for r in modes.permutations(spark).collect():
        targets.setdefault((r.rate_class, r.kbps_ch, r.ch, r.ftype), {})[r.place] = r.target
    for (a, b, ch, k), r in rows.items():
        layout = codec.Layout(a, b, ch)
        bits, lengths, blocks = layout.deal[modes.FRAME_TYPES[k]]
        assert (sum(bits), sum(lengths), blocks, len(bits), layout.frame_bits) == (r.bits, r["size"], r.blocks, r.nd, r.frame_bits)
        own = layout.permutation[modes.FRAME_TYPES[k]]
        assert own.tolist() == [targets[a, b, ch, k][i] for i in range(len(own))]
        assert sorted(own.tolist()) == list(range(len(own)))


@pytest.mark.parametrize("kind", range(9))
def test_frames_decode_with_one_frame_of_history(kind):
    layout = codec.Layout(16, 16, 2)
    c = codec.Codec(layout, _books(layout))
    rng = np.random.default_rng(kind)
    make = lambda k: [k, *(int(rng.integers(2**bits)) for _, bits in layout.fields(codec.TYPE_OF_WINDOW[k]))]
    codes = make(kind)
    a, b = c.decode(codes, None), c.decode(codes, make(kind))
    assert a.shape == (2, layout.n) and np.isfinite(a).all() and np.isfinite(b).all() and not np.allclose(a, b)


@pytest.mark.parametrize(("mode", "channels"), [((8, 8), 1), ((11, 10), 2)])
def test_encode_pack_parse_decode(spark, mode, channels):
    layout = codec.Layout(*mode, channels)
    table = [(name, i, j, float(v)) for name, book in _books(layout).items() for (i, j), v in np.ndenumerate(book)]
    books = codec.load_books(spark.createDataFrame(table, "name string, code int, dim int, value double"))
    c = codec.Codec(layout, books)
    n, t = layout.n, np.arange(5 * layout.n) / 8000
    x = 0.3 * np.sin(2 * np.pi * (437 * t + 70 * t * t)) + 0.06 * np.sin(2 * np.pi * 1123 * t)
    hops = np.concatenate([np.zeros(n), x, np.zeros(n)]).reshape(-1, n)
    blocks = [np.concatenate([hops[f], hops[f + 1]]) for f in range(len(hops) - 1)]
    rows = [("s", f, np.stack([b * (1 - 0.7 * k) for k in range(channels)]).reshape(-1).tolist()) for f, b in enumerate(blocks)]
    frames = codec.encode_frames(spark.createDataFrame(rows, "sig string, frame long, x array<double>"), c)
    codes = {r.frame: r.codes for r in frames.collect()}
    records = codec.pack_frames(frames, layout).withColumn("skip", framing.F.lit(0))
    assert {r.frame: r.codes for r in codec.parse_frames(records, layout).collect()} == codes
    spectra = {r.frame: np.reshape(r.x, (channels, n)) for r in codec.decode_frames(frames, c).collect()}
    want = transform.mdct(np.stack(blocks) * transform.window(n), 2 / n * (-32768 / np.sqrt((2 if channels == 1 else 1) / n)))
    got = np.stack([spectra[f][0] for f in range(len(blocks))])
    assert 10 * np.log10((want**2).sum() / ((want - got) ** 2).sum()) > 2
    assert np.allclose(got[2], c.decode(codes[2], codes[1])[0])
    y = transform.synthesise(got, [0] * len(got), n, layout.form["medium"][0], layout.form["short"][0], stereo=channels == 2)
    assert np.isfinite(y).all() and np.corrcoef(y[n : 5 * n], x[: 4 * n])[0, 1] > 0.6


def test_history_is_kept_by_type_and_over_gaps(spark):
    layout = codec.Layout(16, 16, 2)
    c = codec.Codec(layout, _books(layout))
    rng = np.random.default_rng(4)
    make = lambda k: [k, *(1 if name == "history" else int(rng.integers(2**bits)) for name, bits in layout.fields(codec.TYPE_OF_WINDOW[k]))]
    codes = {f: make(k) for f, k in {0: 0, 1: 2, 2: 1, 4: 4, 5: 2, 7: 7, 8: 3}.items()}
    records = [("s", f, bytearray(layout.pack(x)), 0) for f, x in codes.items()] + [("s", f, bytearray(b"\xf0" + b"\0" * 999), 0) for f in (3, 6)]
    frames = codec.parse_frames(spark.createDataFrame(records, "sig string, frame long, record binary, skip int"), layout)
    got = {r.frame: np.reshape(r.x, (2, layout.n)) for r in codec.decode_frames(frames, c).collect()}
    before = {0: None, 1: 0, 2: 1, 4: 2, 5: 4, 7: 5, 8: 7}
    same = {0: None, 1: None, 2: 0, 4: None, 5: 1, 7: 4, 8: 2}
    assert got.keys() == codes.keys()
    for f, x in got.items():
        # the history as it was, by hand: raw frequencies of one frame, bands of another
        raw = c.state(codes.get(before[f]))[0]
        bands = c.state(codes.get(same[f]))[1]
        own = codec.Codec(layout, c.books)
        own.state = lambda _, raw=raw, bands=bands: (raw, bands)
        assert np.allclose(x, own.decode(codes[f], None))


def test_envelope_of_short_blocks_is_exact():
    layout = codec.Layout(8, 8, 1)
    c = codec.Codec(layout, _books(layout))
    w = np.pi * np.arange(1, 13) / 13
    size = layout.n // 8
    assert np.allclose(c.envelope("short", w), lpc.envelope_at(2 * np.cos(w), np.cos((2 * np.arange(size) + 1) * np.pi / (2 * size))))


@pytest.mark.parametrize("channels", [1, 2])
def test_files_decode_to_samples(spark, tmp_path, channels):
    """A file of records of all types is read, cut, parsed, decoded and synthesised as one line of blocks says."""
    F = framing.F
    layout = codec.Layout(16, 16, channels)
    c = codec.Codec(layout, _books(layout))
    rng = np.random.default_rng(8)
    kinds = [0, 0, 2, 3, 8, 5, 2, 4, 7, 5, 0, 6]
    codes = [[k, *(int(rng.integers(2**bits)) for _, bits in layout.fields(codec.TYPE_OF_WINDOW[k]))] for k in kinds]
    bits = "".join(f"{int.from_bytes(layout.pack(x), 'big') >> (-layout.frame_bits % 8):0{layout.frame_bits}b}" for x in codes)
    data = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    infos = spark.createDataFrame([("a", channels, 16 * channels, 16_000, 0, {"title": "t"})], "file string, channels int, kbps int, rate int, data_size int, tags map<string,string>")
    files = container.build(container.info_chunks(infos), spark.createDataFrame([("a", bytearray(data))], "file string, data binary"))
    container.write(files, str(tmp_path)).collect()
    parsed = container.parse(container.read(spark, f"file://{tmp_path}/a"), keep=("file", "content"))
    headers = container.header_fields(parsed, keep=("file", "content", "data_offset"))
    asked = modes.exact_modes(headers)
    records = container.packets(asked).withColumnRenamed("file", "sig")
    frames = codec.parse_frames(records, layout)
    assert [r.codes for r in frames.orderBy("frame").collect()] == codes
    got = codec.decode_samples(frames, c).collect()
    spectra = {r.frame: np.reshape(r.x, (channels, layout.n)) for r in codec.decode_frames(frames, c).collect()}
    subs = layout.form["medium"][0], layout.form["short"][0]
    lines = [transform.synthesise(np.stack([spectra[f][k] for f in range(len(kinds))]), kinds, layout.n, *subs, stereo=channels == 2) for k in range(channels)]
    if channels == 2:
        lines = [lines[0] + lines[1], lines[0] - lines[1]]
    out = np.full((channels, (len(kinds) - 2) * layout.n), np.nan)
    for r in got:
        out[r.ch, r.i] = r.x
    assert len(got) == out.size and np.allclose(out, np.stack(lines)[:, 2 * layout.n :], rtol=1e-9, atol=1e-12)


def test_frames_that_cannot_be_joined_have_no_samples(spark):
    rows = [("s", 0, 2, [1.0] * 64), ("s", 1, 0, [1.0] * 64), ("s", 2, None, [1.0] * 64), ("s", 3, 9, [1.0] * 64), ("t", 5, 0, [1.0] * 63), ("t", 6, 0, [1.0] * 64), ("u", 0, 0, None), ("v", 0, 0, [1.0] * 64)]
    got = {(r.sig, r.frame): r.x for r in transform.synthesised(spark.createDataFrame(rows, "sig string, frame long, window_type int, x array<double>"), 64, 4, 8).collect()}
    assert {k for k, x in got.items() if x is not None} == {("s", 0), ("v", 0)} and len(got) == len(rows)
    assert transform.synthesised(spark.createDataFrame([], "sig string, frame long, window_type int, x array<double>"), 64, 4, 8).collect() == []


def test_books_are_rows_and_back(spark):
    books = _books(codec.Layout(8, 8, 1))
    back = codec.load_books(codec.book_rows(spark, books))
    assert back.keys() == books.keys() and all((back[k] == v).all() for k, v in books.items())
    assert codec.load_books(codec.book_rows(spark, {})) == {}


@pytest.mark.parametrize("channels", [1, 2])
def test_signals_encode_to_files_and_back(spark, channels):
    """Samples to blocks, codes, records and a file; the file back to samples: nothing of the end is lost."""
    F = framing.F
    layout = codec.Layout(8, 8, channels)
    c = codec.Codec(layout, _books(layout))
    n, length = layout.n, 4 * layout.n + 17
    t = np.arange(length) / 8000
    x = [0.3 * np.sin(2 * np.pi * (437 * t + 70 * t * t)), 0.2 * np.sin(2 * np.pi * 437 * t)][:channels]
    signal = spark.createDataFrame([("a", k, i, float(v)) for k in range(channels) for i, v in enumerate(x[k])] + [("a", 2, 0, 1.0)], "sig string, ch int, i long, x double").repartition(3)
    blocks = codec.signal_blocks(signal, layout)
    hops = np.zeros((channels, 8, n))
    mixed = x if channels == 1 else [(x[0] + x[1]) / 2, (x[0] - x[1]) / 2]
    for k in range(channels):
        hops[k].reshape(-1)[2 * n : 2 * n + length] = mixed[k]
    got = {r.frame: np.reshape(r.x, (channels, 2, n)) for r in blocks.collect()}
    assert sorted(got) == list(range(7)) and all(np.allclose(got[f], hops[:, f : f + 2]) for f in got)
    records = codec.pack_frames(codec.encode_frames(blocks, c), layout)
    data = codec.joined_records(records, layout)
    infos = spark.createDataFrame([("a", channels, 8 * channels, 8000, 0, {})], "file string, channels int, kbps int, rate int, data_size int, tags map<string,string>")
    files = container.build(container.info_chunks(infos), data.withColumnRenamed("sig", "file"))
    headers = container.header_fields(container.parse(files, keep=("file", "content")), keep=("file", "content", "data_offset"))
    frames = codec.parse_frames(container.packets(modes.exact_modes(headers)).withColumnRenamed("file", "sig"), layout)
    assert {r.frame: r.codes for r in frames.collect()} == {r.frame: r.codes for r in codec.parse_frames(records.withColumn("skip", F.lit(0)), layout).collect()}
    out = codec.decode_samples(frames, c).collect()
    assert len(out) == channels * 5 * n
    y = np.zeros((channels, 5 * n))
    for r in out:
        y[r.ch, r.i] = r.x
    assert all(np.corrcoef(y[k, n : 4 * n], x[k][n : 4 * n])[0, 1] > 0.5 for k in range(channels))


def test_files_are_converted_there_and_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "in").mkdir()
    t = np.arange(3000) / 8000
    tone = 0.4 * np.sin(2 * np.pi * 437 * t)
    wavs = {"two": (8000, np.stack([tone, tone / 2], 1)), "odd": (9000, np.stack([tone], 1)), "three": (8000, rng.random((10, 3)))}
    for name, (rate, x) in wavs.items():
        (tmp_path / f"in/{name}.WAV").write_bytes(wav.encode16(x, rate))
    (tmp_path / "in/bad.WAV").write_bytes(b"RIFF")
    table = [codec.book_rows(spark, _books(codec.Layout(8, 8, ch))).withColumns({"rate_class": framing.F.lit(8), "kbps_ch": framing.F.lit(8), "channels": framing.F.lit(ch)}) for ch in (1, 2)]
    table[0].union(table[1]).write.parquet(str(tmp_path / "books"))
    done = {r.file.split("/")[-1]: r for r in convert.main(spark, ["encode", str(tmp_path / "in/*"), str(tmp_path / "mid"), "--books", str(tmp_path / "books"), "-b", "16", "--title", "é"]).collect()}
    assert {n: r.error for n, r in done.items()} == {"two.rec": None, "odd.rec": None, "three.WAV": "channels", "bad.WAV": "no WAV file"}
    (tmp_path / "mid/broken.rec").write_bytes(b"x")
    parsed = container.parse(container.read(spark, f"file://{tmp_path}/mid/two.rec"))
    assert container.pivot_tags(container.exploded(parsed)).first().title == "é"
    back = {r.file.split("/")[-1]: r for r in convert.main(spark, ["decode", str(tmp_path / "mid/*.rec"), str(tmp_path / "out"), "--books", str(tmp_path / "books")]).collect()}
    assert {n: r.error for n, r in back.items()} == {"two.rec": None, "odd.rec": None, "broken.rec": "no container"}
    for name, hops, channels in (("two", 6, 2), ("odd", 6, 1)):
        rate, x = wav.decode(open(back[f"{name}.rec"].path, "rb").read())
        assert (rate, x.shape) == (8000, (512 * hops, channels)) and back[f"{name}.rec"].n == 512 * hops
    _, x = wav.decode(open(back["two.rec"].path, "rb").read())
    assert np.corrcoef(x[512:2560, 0], tone[512:2560])[0, 1] > 0.5
    with pytest.raises(SystemExit):
        convert.parser().parse_args(["encode", "a", "b", "--books", "c", "--colour", "x"])

"""Records and annotations written here byte by byte and scanned again."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from seqloom.sources import waveforms


def pack_212(values):
    values = [v & 0xFFF for v in values] + [0] * (len(values) % 2)
    return b"".join(bytes([a & 255, (a >> 8) | (b >> 8) << 4, b & 255]) for a, b in zip(values[::2], values[1::2], strict=True))


def annotation(*parts):
    return b"".join(struct.pack("<H", code << 10 | low) + more for code, low, more in parts) + b"\0\0"


def test_records(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-2000, 2000, 101), rng.integers(-2000, 2000, 101)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "r1.hea").write_text("r1 2 360 101\nr1.dat 212 200(10)/mV 11 1024 0 0 0 MLII\nr1.dat 212 100/uV 11 5 0 0 0 lead V1\n# 63 M\n# Dx: x\n")
    (tmp_path / "sub" / "r1.dat").write_bytes(pack_212(np.stack([a, b], 1).reshape(-1).tolist()))
    c = rng.integers(-30000, 30000, 40)
    c[3] = -32768
    (tmp_path / "r2.hea").write_text("r2 2 250\nr2.dat 16 50 16 0\nr2b.dat 80 1 8 0 0 0 0 x\n")
    (tmp_path / "r2.dat").write_bytes(c.astype("<i2").tobytes())
    (tmp_path / "r2b.dat").write_bytes(bytes([128, 0, 255]))
    got = {(r.record, r.lead): r for r in waveforms.scan_records(spark, str(tmp_path)).collect()}
    assert len(got) == 4
    one = got["r1", 0]
    assert (one.rate, one.name, one.unit, one.comments) == (360.0, "MLII", "mV", ["63 M", "Dx: x"])
    assert one.signal == pytest.approx(((a - 10) / 200).tolist()) and got["r1", 1].signal == pytest.approx(((b - 5) / 100).tolist())
    assert got["r1", 1].name == "lead V1" and got["r2", 0].rate == 250
    assert got["r2", 0].signal[3] is None and got["r2", 0].signal[4] == c[4] / 50 and got["r2", 1].signal == [0, -128, 127]


def test_a_missing_signal_file_is_an_error(spark, tmp_path):
    (tmp_path / "r.hea").write_text("r 1 250 1\nother.dat 16 1\n")
    with pytest.raises(Exception, match="has no other.dat"):
        waveforms.scan_records(spark, str(tmp_path)).collect()
    for bad in ("", "r 2 250\nr.dat 16 1\n", "r 1 250\nr.dat 16x2 1\n"):
        with pytest.raises(ValueError):
            waveforms.read_header(bad)
    with pytest.raises(ValueError):
        waveforms.read_samples(b"", 310)


def test_annotations(spark, tmp_path):
    aux = b"(AFIB\0"
    data = annotation((28, 18, b""), (63, len(aux), aux), (1, 59, b""), (60, 1, b""), (59, 0, struct.pack("<HH", 1, 2)), (5, 100, b""), (62, 1, b""), (39, 0, b""))
    (tmp_path / "r7.atr").write_bytes(data)
    (tmp_path / "none.atr").write_bytes(b"")
    got = sorted(map(tuple, waveforms.scan_annotations(spark, str(tmp_path)).collect()))
    assert got == [("r7", 18, "+", "(AFIB"), ("r7", 77, "N", ""), ("r7", 77 + 65538 + 100, "(", ""), ("r7", 77 + 65538 + 100, "V", "")]

import struct
import wave

import pytest

from fathomark.operators import labels as lab
from fathomark.sources import files, manifest


def wav(path, seconds=0.25, rate=16000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(struct.pack("<h", 1) * int(seconds * rate))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpora")
    wav(root / "rav/Actor_12/03-01-05-01-01-01-12.wav", 0.5)
    wav(root / "rav/Actor_12/03-02-05-01-01-01-12.wav")  # song: skipped
    wav(root / "rav/Actor_12/odd-name.wav")
    wav(root / "cre/1001_DFA_ANG_XX.wav", 0.125, 8000)
    return root


def test_scan_parse_and_header(spark, corpus):
    df = files.scan_files(spark, {"ravdess": str(corpus / "rav"), "cremad": str(corpus / "cre")})
    got = {r.stem: r for r in files.wav_header(files.with_digest(files.parse_names(df))).collect()}
    assert set(got) == {"03-01-05-01-01-01-12", "odd-name", "1001_DFA_ANG_XX"}
    a = got["03-01-05-01-01-01-12"]
    assert (a["item_id"], a["speaker_id"], a["raw"]) == ("ravdess/03-01-05-01-01-01-12", "ravdess_12", "angry")
    assert a["sample_rate"] == 16000 and a["duration_s"] == 0.5 and len(a["sha256"]) == 64
    assert got["1001_DFA_ANG_XX"]["duration_s"] == 0.125 and got["1001_DFA_ANG_XX"]["session_id"] == ""
    assert not got["odd-name"]["parsed"]


def test_missing_root_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_files(spark, {"ravdess": str(tmp_path / "none")}).count()


def test_annotations(spark, tmp_path):
    good = tmp_path / "Session1/dialog/EmoEvaluation"
    (good / "Categorical").mkdir(parents=True)
    line = "[6.2901 - 8.2357]\t{}\t{}\t[2.5000, 2.5000, 2.5000]"
    (good / "Ses01F_impro01.txt").write_text("\n".join([
        "% [START_TIME - END_TIME] TURN_NAME EMOTION [V, A, D]", line.format("Ses01F_impro01_F000", "neu"), "C-E2: Neutral;",
        line.format("Ses01F_impro01_M001", "ang"), line.format("Ses01F_impro01_M002", "zzz")]))
    (good / "again.txt").write_text(line.format("Ses01F_impro01_M001", "sad"))
    (good / "Categorical/other.txt").write_text(line.format("Ses01F_impro01_F009", "neu"))
    notes = files.scan_annotations(spark, str(tmp_path))
    assert {r.item for r in notes.collect()} == {"Ses01F_impro01_F000", "Ses01F_impro01_M001", "Ses01F_impro01_M002"}
    assert {r["item"]: r.problem for r in files.annotation_errors(notes).collect()} == {
        "Ses01F_impro01_M002": "unknown code zzz", "Ses01F_impro01_M001": "angry and sad"}
    assert {r["item"]: r.raw for r in files.annotation_labels(notes).collect()}["Ses01F_impro01_F000"] == "neutral"


def test_session_ids(spark):
    df = spark.createDataFrame([("iemocap", "Ses05M_script03_2_M012"), ("iemocap", "Ses01F_impro01_F000"), ("iemocap", "nope")], "corpus string, stem string")
    got = {r.stem: r for r in files.parse_names(df).collect()}
    r = got["Ses05M_script03_2_M012"]
    assert (r["session_id"], r["subset"], r["speaker_id"]) == ("Ses05", "scripted", "iemocap_Ses05M")
    assert got["Ses01F_impro01_F000"]["subset"] == "improvised" and not got["nope"]["parsed"]


def item(spark, **over):
    row = dict(zip(manifest.COLUMNS, ["c", "/data/c/a/x.wav", "c/x", "s1", None, None, "happy", "happy", None, 1.5, 16000, "ff"]))
    row.update(over)
    return spark.createDataFrame([tuple(row.values())], manifest.schema())


def test_manifest_round_trip_and_header(spark, tmp_path):
    df = item(spark)
    path = str(tmp_path / "m")
    manifest.write_manifest(df, path)
    assert manifest.read_manifest(spark, path).collect() == df.collect()
    df.drop("sha256").write.option("header", "true").csv(str(tmp_path / "bad"))
    with pytest.raises(manifest.ManifestError):
        manifest.read_manifest(spark, str(tmp_path / "bad"))


def test_portable_form(spark, tmp_path):
    roots = spark.createDataFrame([("c", "/data/c/")], "corpus string, root string")
    df = item(spark).unionByName(item(spark, file_path="/other/x.wav", utterance_id="c/y")).unionByName(
        item(spark, file_path="/data/c/../d.wav", utterance_id="c/z"))
    port = manifest.to_portable(df, roots)
    assert {r.utterance_id for r in manifest.outside_root(port).collect()} == {"c/y", "c/z"}
    inside = port.where("relative_path IS NOT NULL")
    assert inside.first()["relative_path"] == "a/x.wav"
    path = str(tmp_path / "p")
    manifest.write_manifest(inside, path, manifest.PORTABLE)
    here = spark.createDataFrame([("c", "/mnt/c")], "corpus string, root string")
    got = manifest.load_items(spark, path, str(tmp_path / "none"), here).first()
    assert got["file_path"] == "/mnt/c/a/x.wav"
    manifest.write_manifest(item(spark), str(tmp_path / "local"))
    assert manifest.load_items(spark, str(tmp_path / "nope"), str(tmp_path / "local"), here).count() == 1


@pytest.mark.parametrize("corpus,raw,space,want", [
    ("ravdess", "calm", "six", "neutral"), ("ravdess", "surprised", "six", None), ("iemocap", "excited", "four", "happy"),
    ("iemocap", "frustrated", "four", None), ("iemocap", "xxx", "four", None), ("iemocap", "fear", "four", None), ("CREMAD ", " Sad", "six", "sad"),
])
def test_label_policy(spark, corpus, raw, space, want):
    df = spark.createDataFrame([(corpus, raw)], "corpus string, raw string")
    got = lab.map_labels(df, lab.LabelPolicy().rules(spark), space).first()
    assert got["label"] == want and got["known"]


def test_unknown_label_and_policies(spark):
    df = spark.createDataFrame([("cremad", "bored"), ("iemocap", "frustrated")], "corpus string, raw string")
    assert {r.raw for r in lab.unknown_labels(df, lab.LabelPolicy().rules(spark)).collect()} == {"bored"}
    merged = lab.LabelPolicy(frustrated="merge_angry", calm_to_neutral=False).rules(spark)
    assert lab.map_labels(df.where("raw = 'frustrated'"), merged, "four").first()["label"] == "angry"
    with pytest.raises(ValueError):
        lab.LabelPolicy(frustrated="maybe")


def chunk(name, body):
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def test_headers_by_chunk(spark):
    form = chunk(b"fmt ", (1).to_bytes(2, "little") + (2).to_bytes(2, "little") + (22050).to_bytes(4, "little") + (88200).to_bytes(4, "little") + (4).to_bytes(2, "little") + (16).to_bytes(2, "little"))
    start = b"RIFF" + b"\0" * 4 + b"WAVE"
    data = chunk(b"data", b"x" * 4410)
    cases = {
        "plain": (start + form + data, 22050, 0.05, None), "list first": (start + chunk(b"LIST", b"odd") + form + chunk(b"fact", b"1234") + data, 22050, 0.05, None),
        "extensible": (start + chunk(b"fmt ", form[8:] + b"\0" * 24) + data, 22050, 0.05, None),
        "cut data": (start + form + data[:-10], None, None, "data chunk is cut"), "no data": (start + form, None, None, "no data chunk"),
        "no format": (start + chunk(b"LIST", b""), None, None, "no format chunk"), "early data": (start + data + form, None, None, "data before a format chunk"),
        "cut format": (start + form[:14], None, None, "format chunk is cut"), "other": (b"OggS" + b"\0" * 60, None, None, "not a RIFF/WAVE file"), "empty": (b"", None, None, "not a RIFF/WAVE file"),
        "null": (None, None, None, "not a RIFF/WAVE file"), "no rate": (start + chunk(b"fmt ", b"\0" * 16) + data, None, None, "format chunk without a rate"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, content binary")
    got = {r.name: (r.sample_rate, r.duration_s, r.header_problem) for r in files.wav_header(df).collect()}
    # 4410 bytes are 1102 whole frames of 4.
    want = {k: v[1:] if v[1] is None else (22050, round(1102 / 22050, 6), None) for k, v in cases.items()}
    assert got == want

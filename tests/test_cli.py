"""The six commands on small corpora, through files."""

import json
import zipfile

import pytest

from textloom import cli, pipeline
from textloom.operators.profile import Profile, Step
from textloom.sources import profiles as store

TEXTS = ["la casa roja", "la casa verde", "la casa azul", "la manzana roja", "la pera verde esta rica", "la manzana verde esta rica"]


@pytest.fixture(autouse=True)
def session(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    monkeypatch.setenv("TEXTLOOM_HOME", str(tmp_path / "home"))


@pytest.fixture
def corpus(tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join(json.dumps({"doc_id": i, "text": t}) for i, t in enumerate(TEXTS)))
    return str(path)


def config(tmp_path, **fit):
    path = tmp_path / "fit.toml"
    fit = {"encoder": "none", "lemmas": False, "doc_freq_threshold": 0.9} | fit
    path.write_text("[fit]\n" + "\n".join(f"{k} = {json.dumps(v)}" for k, v in fit.items()))
    return str(path)


def run(capsys, *args):
    capsys.readouterr()
    assert cli.main([str(a) for a in args]) == 0
    return capsys.readouterr().out.split("\n")[:-1]


def test_fit_merge_refit_search(spark, tmp_path, corpus, capsys):
    cfg = config(tmp_path, batch_size=3)
    parts = run(capsys, "fit", corpus, "--config", cfg, "--output", tmp_path / "p.zip")
    assert [p.rsplit("-", 1)[1] for p in parts] == ["00000.zip", "00001.zip"]
    run(capsys, "merge", *parts, "--output", tmp_path / "all.zip")
    merged = store.load_profile(spark, str(tmp_path / "all.zip"))
    assert merged.model.voc.trainsize == 6 and merged.model.voc.get("verde") == {"token": "verde", "occs": 3, "ndocs": 3}
    assert "la" in merged.stopwords and merged.lineage_summary() == "merge"
    run(capsys, "refit", tmp_path / "all.zip", corpus, "--output", tmp_path / "own.zip", "--base-weight", 0.5)
    tuned = store.load_profile(spark, str(tmp_path / "own.zip"))
    assert tuned.istuned and tuned.lineage[-1].params["kappa"] == 6
    hits = run(capsys, "search", tmp_path / "all.zip", "manzana verde", corpus, "--threshold", 2)
    assert [json.loads(h)["doc_id"] for h in hits] == [5]
    info = json.loads("\n".join(run(capsys, "info", tmp_path / "all.zip")))
    assert info["trainsize"] == 6 and info["lineage"][0]["kind"] == "merge"


def test_resume_fits_nothing_twice(tmp_path, corpus, capsys, monkeypatch):
    cfg = config(tmp_path, batch_size=2)
    first = run(capsys, "fit", corpus, "--config", cfg, "--output", tmp_path / "p.zip")
    (tmp_path / "p-00001.zip").unlink()
    fitted = []
    real = pipeline.fit_profile
    monkeypatch.setattr(pipeline, "fit_profile", lambda *a: fitted.append(a) or real(*a))
    again = run(capsys, "fit", corpus, "--config", cfg, "--output", tmp_path / "p.zip", "--resume")
    assert len(first) == 3 and again == [str(tmp_path / "p-00001.zip")] and len(fitted) == 1


def test_registry(spark, tmp_path, corpus, capsys):
    run(capsys, "fit", corpus, "--config", config(tmp_path), "--output", tmp_path / "p.zip")
    assert run(capsys, "list") == []
    at = run(capsys, "install", tmp_path / "p.zip", "--nickname", "mine")
    assert at == [str(store.profile_path("mine"))] and run(capsys, "list") == ["mine"]
    assert store.default_nickname("/a/b.zip") == "b" and store.resolve("mine") == at[0] and store.expand_specs([str(store.profiles_dir())]) == at
    assert [json.loads(x)["doc_id"] for x in run(capsys, "search", "mine", "pera", corpus)] == [4]
    # told, not removed
    assert run(capsys, "uninstall", "mine") == at and run(capsys, "list") == ["mine"]
    with pytest.raises(SystemExit):
        cli.main(["uninstall", "nobody"])
    with pytest.raises(ValueError):
        store.expand_specs(["nobody"])


@pytest.mark.parametrize("args", [["merge", "{p}", "--output", "x.zip"], ["refit", "{p}", "{c}", "--output", "x.zip", "--kappa", "1", "--base-weight", "0.5"], ["refit", "{p}", "{c}", "--output", "x", "--kappa", "1"], ["refit", "{p}", "{c}", "--output", "x.zip", "--extend-lemmas", "--no-lemmas"], ["refit", "{p}", "{c}", "--output", "x.zip", "--base-weight", "1"]])
def test_refused(tmp_path, corpus, capsys, args):
    path = tmp_path / "p.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("manifest.json", json.dumps({"format_version": store.FORMAT_VERSION}))
    with pytest.raises(SystemExit):
        cli.main([a.format(p=path, c=corpus) for a in args])


def test_other_format_is_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"format_version": "other"}))
    with pytest.raises(ValueError):
        store.load_profile(spark, str(tmp_path / "p.zip"))


def test_lineage():
    p = Profile(None, lineage=(Step("fit"), Step("refit", {"kappa": 1.0})))
    assert p.istuned and not p.isbase and p.lineage_summary() == "fit -> refit" and p.with_applied(lemmas=True).applied.lemmas

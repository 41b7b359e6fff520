"""Rule formats, validation, corpora, command line."""

import json
import subprocess

import pytest

from rulesieve import cli
from rulesieve.errors import InputError, RuleError
from rulesieve.sources import corpus, formats
from rulesieve.sources.rules import checked, load_files, load_rules


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rules_json(tmp_path, rows, name="r.json"):
    return put(tmp_path / name, json.dumps(rows))


def test_plain_formats(tmp_path):
    rows = [{"name": "a", "pattern": "x+", "level": "high", "note": 1}]
    files = [
        rules_json(tmp_path, rows), rules_json(tmp_path, {"rules": rows}, "o.json"), put(tmp_path / "y.yaml", "- id: a\n  regex: x+\n  level: high\n  note: 1\n"),
        put(tmp_path / "c.csv", "name,pattern,level,note\na,x+,high,1\n"), put(tmp_path / "t.toml", '[[rule]]\nx = 1\n'),
    ]
    for f in files[:4]:
        (r,) = load_rules(f)
        assert (r.name, r.pattern, r.severity, str(r.metadata["note"])) == ("a", "x+", "high", "1")
    for bad in (files[4], str(tmp_path / "no.json"), put(tmp_path / "x.xml", "<a/>"), put(tmp_path / "b.json", "{"), rules_json(tmp_path, [], "e.json")):
        with pytest.raises(InputError):
            load_rules(bad)


@pytest.mark.parametrize(
    "bad",
    ["text", {"pattern": "x"}, {"name": "", "pattern": "x"}, {"name": "ok", "pattern": "y"}, {"name": "n"}, {"name": "n", "pattern": "  "}, {"name": "n", "pattern": "("}, {"name": "n", "pattern": "a(?i)b"}],
)
def test_validation(tmp_path, bad):
    f = rules_json(tmp_path, [{"name": "ok", "pattern": "x"}, bad])
    with pytest.raises(RuleError) as e:
        load_rules(f)
    assert e.value.entry == 2
    assert [r.name for r in load_rules(f, skip_invalid=True)] == ["ok"]
    assert isinstance(list(checked(f))[1], RuleError)


def test_a_rejected_rule_reserves_its_name(tmp_path):
    f = rules_json(tmp_path, [{"name": "a", "pattern": "("}, {"name": "a", "pattern": "x"}, {"name": "b", "pattern": "y"}])
    assert [r.name for r in load_rules(f, skip_invalid=True)] == ["b"]


def test_mapping_priorities_and_metadata(tmp_path):
    f = rules_json(tmp_path, [{"title": "a", "name": "b", "pattern": "x", "tags": "no list", "metadata": {"k": 1}, "extra": 2}], "one.json")
    g = rules_json(tmp_path, [{"name": "c", "pattern": None, "regex": "y"}], "two.json")
    (a,) = load_rules(f, field_mapping={"name": "title"})
    assert (a.name, a.tags, a.metadata) == ("a", (), {"k": 1})
    rules = load_files([f, g], priorities={"two.json": 7})
    assert [(r.name, r.priority, r.pattern) for r in rules] == [("b", 20, "x"), ("c", 7, "None")]


def test_gitleaks(tmp_path):
    f = put(tmp_path / "g.toml", '[[rules]]\nid = "k"\nregex = \'\'\'k[0-9]{4}\'\'\'\nentropy = 3.6\nkeywords = ["k"]\nsecretGroup = 1\ntags = ["t"]\n[[rules]]\nid = "p"\nregex = "p"\nkeywords = ["p"]\n[[rules]]\nid = "m"\nregex = "m"\n[[rules]]\nid = "none"\n')
    rules = load_rules(f)
    assert [(r.name, r.severity, r.detector) for r in rules] == [("k", "critical", "secrets"), ("p", "high", "secrets"), ("m", "medium", "secrets")]
    assert rules[0].metadata == {"entropy": 3.6, "secret_group": 1, "keywords": ["k"]} and rules[0].tags == ("t",)


def test_semgrep(tmp_path):
    f = put(tmp_path / "s.yaml", "rules:\n- id: one\n  severity: ERROR\n  pattern-regex: a+\n  message: m\n- id: two\n  patterns:\n  - pattern-regex: b\n  - pattern-not-regex: c\n  pattern-either:\n  - pattern-regex: d\n  metadata: {technology: [py]}\n- id: ast\n  pattern: foo()\n")
    assert [(r.name, r.pattern, r.severity, r.tags) for r in load_rules(f)] == [("one", "a+", "critical", ()), ("two_1", "b", "medium", ("py",)), ("two_2", "d", "medium", ("py",))]


def test_sigma(tmp_path):
    f = put(tmp_path / "s.yml", "title: T\nid: u1\nlevel: informational\nlogsource: {product: w}\ndetection:\n  sel:\n    Cmd|re: [a+, b+]\n    Other|contains: x\n  more:\n  - Img|utf16|re: c\n  condition: sel\n---\ntitle: Alone\ndetection:\n  sel: {F|re: z}\n")
    assert [(r.name, r.pattern, r.severity) for r in load_rules(f)] == [("u1:Cmd_1", "a+", "low"), ("u1:Cmd_2", "b+", "low"), ("u1:Img_3", "c", "low"), ("Alone", "z", "medium")]


def test_yara(tmp_path):
    f = put(tmp_path / "y.yar", 'import "pe"\n/* rule no { */\nrule One : t1 t2 {\n  meta:\n    severity = "high" // why\n    n = 3\n    live = true\n  strings:\n    $a = /https?:\\/\\/x[0-9]+/ nocase\n    $t = "text"\n  condition:\n    $a\n}\nrule Two\n{\n  strings:\n    $b = /y{2}/\n    $c = /z/\n  condition: any of them\n}\n')
    rules = load_rules(f)
    assert [(r.name, r.pattern, r.severity, r.tags) for r in rules] == [("One:a", "https?://x[0-9]+", "high", ("t1", "t2")), ("Two:b", "y{2}", "medium", ()), ("Two:c", "z", "medium", ())]
    assert rules[0].metadata == {"n": 3, "live": True, "yara_modifiers": "nocase"}


def test_snort(tmp_path):
    f = put(tmp_path / "s.rules", '# c\nalert tcp any any -> any any (msg:"M"; pcre:"/a\\/b/i"; pcre:"/c/"; sid:7; classtype:web; priority:1;)\nalert tcp any any (msg:"no"; sid:8;)\ndrop udp any any (pcre:"/d/";)\n')
    rules = load_rules(f)
    assert [(r.name, r.pattern, r.severity, r.tags) for r in rules] == [("sid:7_pcre1", "a/b", "critical", ("web",)), ("sid:7_pcre2", "c", "critical", ("web",)), ("sid:4", "d", "medium", ())]
    assert rules[0].metadata == {"message": "M", "classtype": "web", "pcre_modifiers": "i"}


def test_adapters_register_once_and_come_first(tmp_path):
    class Own:
        name = "own"

        def can_load(self, path):
            return path.endswith(".own")

        def load(self, path):
            return [{"name": "n", "pattern": "p"}]

    n = len(formats.adapters())
    formats.register(Own())
    formats.register(Own())
    assert len(formats.adapters()) == n + 1 and [a.name for a in formats.adapters()][:5] == ["gitleaks", "semgrep", "sigma", "yara", "snort"]
    assert load_rules(put(tmp_path / "x.own", ""))[0].name == "n"


def test_jsonl(spark, tmp_path):
    f = put(tmp_path / "c.jsonl", '{"text": "a", "label": "l", "source": "s"}\n\nnot json\n[1]\n{"text": ""}\n{"text": 5, "label": null}\n{"body": "b"}\n{"text": true}\n')
    assert sorted(tuple(r) for r in corpus.load_jsonl(spark, f).drop("entry_id").collect()) == [("5", "None", ""), ("True", "", ""), ("a", "l", "s")]
    assert corpus.load_jsonl(spark, f, text_field="body").count() == 1
    for bad in (str(tmp_path / "none.jsonl"), put(tmp_path / "e.jsonl", "\n")):
        with pytest.raises(InputError):
            corpus.load_jsonl(spark, bad)


def test_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    for n, text in enumerate(["one\ntwo\n\n", "two\nthree\n" + "x" * 600 + "\n"]):
        put(tmp_path / f"f{n}.txt", text)
        git("add", ".")
        git("commit", "-qm", f"c{n}")
    rows = {r["text"]: r["source"] for r in corpus.load_git(spark, str(tmp_path)).collect()}
    assert set(rows) == {"one", "two", "three"} and rows["two"].endswith(":f1.txt") and len(rows["one"].split(":")[0]) == 7
    with pytest.raises(InputError):
        corpus.load_git(spark, str(tmp_path / "nowhere"))


def test_first_seen(spark):
    lines = spark.createDataFrame([("a", 2, 0), ("a", 1, 5), ("b", 1, 1)], "line string, doc int, pos int")
    assert sorted(tuple(r) for r in corpus.first_seen(lines, "line", ["doc", "pos"]).collect()) == [("a", 1, 5), ("b", 1, 1)]


@pytest.fixture
def pack(tmp_path):
    return rules_json(tmp_path, [{"name": "a", "pattern": "k[0-9]{8}"}, {"name": "b", "pattern": "k\\d{8}"}, {"name": "c", "pattern": "zebra[a-f]{6,9}"}])


@pytest.fixture
def no_new_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda *a: spark)


def test_scan_formats_and_exit_codes(pack, tmp_path, no_new_session, capsys):
    assert cli.main(["scan", pack, "--samples", "20", "--format", "json", "--fail-on-duplicate", "-o", str(tmp_path / "o.json")]) == 1
    report = json.loads((tmp_path / "o.json").read_text())
    assert [(p["rule_a"], p["rule_b"]) for p in report["results"]["duplicates"]] == [("a", "b")]
    assert report["summary"]["duplicate_pairs"] == 1 and report["input"]["total_rules"] == 3 and report["results"]["clusters"][0]["rules"] == ["a", "b"]
    for form in ("table", "csv", "summary"):
        assert cli.main(["scan", pack, "--samples", "20", "--format", form]) == 0
    out = capsys.readouterr().out
    assert "Duplicates (1 pairs)" in out and "rule_a,rule_b,source_a" in out and "Found 1 duplicate pair(s)" in out


def test_compare_partitions_and_priorities(pack, tmp_path, no_new_session, capsys):
    other = rules_json(tmp_path, [{"name": "a", "pattern": "k[0-9]{8}", "detector": "d"}], "other.json")
    assert cli.main(["compare", pack, other, "--samples", "20", "--priority", "other.json=99", "--format", "csv"]) == 0
    assert "keep_b" in capsys.readouterr().out
    assert cli.main(["scan", pack, other, "--samples", "20", "--partition-by", "detector", "--format", "csv"]) == 0
    assert "other.json" not in capsys.readouterr().out
    assert cli.main(["scan", pack, "--partition-by", "tags"]) == 2
    assert cli.main(["compare", pack, "--priority", "x"]) == 2


def test_other_commands(pack, tmp_path, no_new_session, capsys):
    assert cli.main(["validate", pack]) == 0 and "3 valid rules" in capsys.readouterr().out
    assert cli.main(["validate", rules_json(tmp_path, [{"name": "x", "pattern": "("}], "bad.json")]) == 2
    assert cli.main(["generate-corpus", pack, "--samples", "12", "-o", str(tmp_path / "c.json")]) == 0
    assert {e["source_rule"] for e in json.loads((tmp_path / "c.json").read_text())} == {"a", "b", "c"}
    data = put(tmp_path / "d.jsonl", '{"text": "k12345678", "label": "a"}\n{"text": "no"}\n')
    none = put(tmp_path / "n.jsonl", '{"text": "no"}\n')
    assert cli.main(["evaluate", pack, "--corpus", data]) == 0
    assert "Top co-firing pairs (1)" in capsys.readouterr().out
    assert cli.main(["evaluate", pack, "--corpus", data, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["labeled_entries"] == 1
    assert cli.main(["evaluate", pack, "--corpus", data, "--format", "summary"]) == 0 and "2 rules fired" in capsys.readouterr().out
    assert cli.main(["diff", pack, "--corpus-a", data, "--corpus-b", none]) == 0 and "significant drift (2)" in capsys.readouterr().out
    assert cli.main(["diff", pack, "--corpus-a", none, "--corpus-b", none, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["results"] == []
    assert cli.main(["evaluate", pack, "--corpus", str(tmp_path / "none")]) == 2


def test_json_logs(tmp_path):
    from rulesieve.logs import setup

    setup("info", str(tmp_path / "l"), "json").info("hi %s", "x")
    assert json.loads((tmp_path / "l").read_text())["message"] == "hi x"
    setup()


def test_a_broken_adapter_file_is_bad_input(tmp_path, capsys):
    f = put(tmp_path / "r.yaml", "rules:\n  - id: a\n    pattern-regex: \"x\n  bad: [\n")
    assert cli.main(["validate", f]) == 2 and "ERROR" in capsys.readouterr().err
    assert cli.main(["validate", put(tmp_path / "s.yml", "title: x\nlogsource: {}\ndetection: [\n")]) == 2


def test_only_a_boolean_is_a_catch_all(spark):
    from rulesieve.sources.rules import rules_of_table

    told = ['{"catch_all": true}', '{"catch_all": false}', '{"catch_all": "true"}', '{"catch_all": 1}', "{}", None, "no json"]
    df = spark.createDataFrame(list(enumerate(told)), "rule_id int, metadata string")
    assert [r["catch_all"] for r in rules_of_table(df).orderBy("rule_id").collect()] == [True, False, None, None, None, None, None]


def test_snort_options_keep_quotes_and_escapes():
    line = 'alert tcp any any -> any any (msg:"a; b:c"; content:"x\\;y"; pcre:"/a\\/b;c\\"d/Ui"; pcre:!"/neg/"; sid: 42 ; priority:2; classtype:web-app;)'
    got = {k: v for k, v, _ in formats.Snort.options(line)}
    assert got["msg"] == "a; b:c" and got["sid"] == "42" and got["classtype"] == "web-app"
    one, *rest = formats.Snort()._many(line, 7)
    assert one["pattern"] == 'a/b;c\\"d' and one["metadata"]["pcre_modifiers"] == "Ui" and one["severity"] == "high" and one["name"].startswith("sid:42")


def test_warnings(spark, tmp_path, caplog):
    f = put(tmp_path / "c.jsonl", '{"text": "a"}\nno\n[1]\n')
    with caplog.at_level("WARNING", "rulesieve"):
        assert corpus.load_jsonl(spark, f).count() == 1
    assert "2 lines" in caplog.text

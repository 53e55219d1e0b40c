import json

from murmura.operators import nested

LISTS = ("storage_refs", "items")


def brute(payload):
    """Paths by a plain recursive parse."""
    try:
        o = json.loads(payload)
    except ValueError:
        return set()
    out = set()

    def listed(v):
        return [v] if isinstance(v, dict) else v if isinstance(v, list) else []

    def attachment(a, path):
        if isinstance(a, str):
            try:
                a = json.loads(a)
            except ValueError:
                return
        if not isinstance(a, dict):
            return
        out.add(path)
        for i, r in enumerate(listed(a.get("storage_refs"))):
            if isinstance(r, dict):
                out.add(f"{path}.storage_refs[{i}]")
                out.update(f"{path}.storage_refs[{i}].variants[{j}]" for j, v in enumerate(listed(r.get("variants"))) if isinstance(v, dict))
        t = a.get("transcription")
        for i, s in enumerate(listed(t.get("segments")) if isinstance(t, dict) else []):
            if isinstance(s, dict):
                out.add(p := f"{path}.transcription.segments[{i}]")
                out.update(f"{p}.words[{j}]" for j, v in enumerate(listed(s.get("words"))) if isinstance(v, dict))
        for i, x in enumerate(listed(a.get("items"))):
            attachment(x if isinstance(x, dict) else None, f"{path}.items[{i}]")

    if isinstance(o, dict):
        attachment(o.get("attachment"), "attachment")
    return out


CASES = [
    '{"attachment": {}}',
    '{"attachment": null}',
    '{"attachment": [{"type": "x"}]}',
    '[]',
    '{"attachment": {"storage_refs": {"bucket": "a{\\"", "variants": [null, {"size": "3"}, [], {}]}}, "id": "]["}',
    '{"attachment": {"items": [null, {"items": [{"items": [{}], "transcription": {"segments": [{"words": [{"w": "a\\\\", "p": "0.5"}, null, {}]}]}}]}]}}',
    '{"attachment": {"type": "a"}, "attachment": {"storage_refs": [1, "x", {"bucket": "b"}]}}',
    json.dumps({"attachment": json.dumps({"storage_refs": [{"object": "ü\"\n"}]})}),
    json.dumps({"attachment": "no json"}),
    '{"attachment": {"type": "cut off',
    '{"\\u0061ttachment": {"type": "é"}}',
    '"text"',
    '7',
    "",
    '  {"attachment" : { "items" : [ ] } }  ',
]


def test_paths_against_plain_parse():
    rows = nested.nodes_of([(i, c) for i, c in enumerate(CASES)])
    for i, c in enumerate(CASES):
        mine = [r[2] for r in rows if r[0] == i and r[1] != "other"]
        assert len(mine) == len(set(mine))
        assert set(mine) == brute(c), c
    assert nested.nodes_of([]) == []


def test_fields_and_tables(spark):
    df = spark.createDataFrame([(i, c, "clash") for i, c in enumerate(CASES)] + [(90, None, None)], "record_id bigint, payload string, kind string")
    n = nested.nodes(df)
    words = {(r.node_path, r.w, r.p) for r in nested.words(n).collect()}
    assert ("attachment.items[1].items[0].transcription.segments[0].words[0]", "a\\", 0.5) in words
    refs = {(r.record_id, r.bucket, r.object) for r in nested.storage_refs(n).collect()}
    assert (4, 'a{"', None) in refs and (7, None, 'ü"\n') in refs and (6, "b", None) in refs
    every = {(r.record_id, r.node_path): r.parent_path for r in n.collect()}
    assert all(p is None or (i, p) in every for (i, _), p in every.items())
    assert nested.nodes(df.limit(0)).count() == 0


def test_message_refs(spark):
    df = spark.createDataFrame(
        [("a", ([("b", "o"), None, ("c", None)],)), ("a", ([("b", "o"), None, ("c", None)],)), ("n", None), ("e", ([],))],
        "id string, attachment struct<storage_refs:array<struct<bucket:string,object:string>>>",
    )
    assert {tuple(r) for r in nested.message_refs(df).collect()} == {("a", 0, "b", "o"), ("a", 2, "c", None)}


def test_nothing_is_lost():
    long = "k" * 300
    payload = {"attachment": {"type": "a", "meta": {long: {"x": {"y": 1}}}, "tags": ["u", None, "v", 3, ["w", {"z": 0}]], "other": [{"a": {"b": "c"}, "more": [{"d": 1}]}], "storage_refs": [{"bucket": "b", "items": {"n": 2}}, 7], "variants": {"q": 1}, "items": "none"}}
    rows = {r[2]: r for r in nested.nodes_of([(1, json.dumps(payload))])}
    top = dict(rows["attachment"][5])
    assert top == {"type": "a", f"meta.{long}.x.y": "1", "variants.q": "1", "items": "none"}
    assert {p: (r[1], r[3], r[4], dict(r[5])) for p, r in rows.items() if p != "attachment"} == {
        "attachment.tags[0]": ("other", "attachment", 0, {"value": "u"}),
        "attachment.tags[2]": ("other", "attachment", 2, {"value": "v"}),
        "attachment.tags[3]": ("other", "attachment", 3, {"value": "3"}),
        "attachment.tags[4]": ("other", "attachment", 4, {}),
        "attachment.tags[4][0]": ("other", "attachment.tags[4]", 0, {"value": "w"}),
        "attachment.tags[4][1]": ("other", "attachment.tags[4]", 1, {"z": "0"}),
        "attachment.other[0]": ("other", "attachment", 0, {"a.b": "c"}),
        "attachment.other[0].more[0]": ("other", "attachment.other[0]", 0, {"d": "1"}),
        "attachment.storage_refs[0]": ("storage_ref", "attachment", 0, {"bucket": "b", "items.n": "2"}),
        "attachment.storage_refs[1]": ("other", "attachment", 1, {"value": "7"}),
    }


def test_any_depth():
    deep = '{"attachment":' + '{"type":"t","items":[' * 3_000 + "]}" * 3_000 + "}"
    assert nested.readable(deep) and len(nested.nodes_of([(1, deep)])) == 3_000
    inner = '{"attachment":{"meta":' + '{"a":' * 30_000 + "1" + "}" * 30_000 + "}}"
    assert len(nested.nodes_of([(1, inner)])[0][5]) == 1
    assert not nested.readable("[" * 100_000 + "]" * 99_999)


def test_own_check_agrees_with_the_library():
    texts = [*CASES, "[1,2,]", "[,]", '{"a":1,}', '{"a" 1}', '{1:2}', '"\\x"', '"a\nb"', "01", "-", "1.", "[1 2]", "]", "{}{}", " [ ] ", '{"a":[{},[],null,true,-1.5e3]}', "NaN", "tru", '{"a":}', '["\\u00e"]', "[[]"]
    assert [nested._valid(t) for t in texts] == [nested.readable(t) for t in texts]

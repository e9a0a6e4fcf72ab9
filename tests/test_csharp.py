"""The declaration parser."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmine.csharp.parser import parse_source

from .fixtures import BROKEN, HERBS, NOTHING, SHAPES


def parsed(text: str) -> dict:
    return parse_source(text.encode())


def test_types():
    out = parsed(SHAPES)
    assert out["parse_status"] == "OK" and out["parse_error"] is None
    kinds = {t["full_name"]: t["kind"] for t in out["types"]}
    assert kinds == {
        "Garden.Beds.Bed": "class", "Garden.Beds.Bed.Corner": "class", "Garden.Beds.Bed.Corner.Side": "enum", "Garden.Beds.Plot": "class", "Garden.Beds.IWatered": "interface", "Garden.Beds.Seed": "struct",
        "Garden.Beds.Grown": "delegate", "Garden.Beds.Harvest": "record", "Loose": "class",
    }
    bed, corner = out["types"][0], next(t for t in out["types"] if t["name"] == "Corner")
    assert (bed["visibility"], bed["is_abstract"], bed["start_line"], corner["parent"]) == ("public", 1, 6, bed["ordinal"])
    assert next(t for t in out["types"] if t["name"] == "Loose")["visibility"] == "internal"


def test_members():
    out = parsed(SHAPES)
    bed = out["types"][0]["ordinal"]
    signatures = [m["signature"] for m in out["methods"] if m["type"] == bed]
    assert signatures == [".ctor()", ".cctor()", "Water(int)", "Water(string,int)", "Log(string)"]
    water = next(m for m in out["methods"] if m["signature"] == "Water(int)")
    assert (water["return_type"], water["is_virtual"], water["is_static"], water["is_override"]) == ("void", 1, 0, 0)
    assert next(m for m in out["methods"] if m["name"] == ".ctor")["return_type"] is None
    fields = {f["name"]: f for f in out["fields"] if f["type"] == bed}
    assert {n: (f["field_type"], f["is_const"], f["is_static"], f["is_readonly"], f["visibility"]) for n, f in fields.items()} == {"Rows": ("int", 1, 0, 0, "private"), "Columns": ("int", 1, 0, 0, "private"), "Label": ("string", 0, 1, 1, "public")}
    assert {p["name"]: (p["has_getter"], p["has_setter"]) for p in out["properties"]} == {"Moisture": (1, 1), "IsDry": (1, 0)}


def test_bases_and_strings():
    out = parsed(SHAPES)
    bed = out["types"][0]["ordinal"]
    assert [(b["relation"], b["target_name"]) for b in out["inheritance"] if b["type"] == bed] == [("base", "Plot"), ("interface", "IWatered")]
    values = [s["value"] for s in out["strings"]]
    assert values.count("water the bed") == 2 and "garden/bed_one" in values
    label = next(s for s in out["strings"] if s["value"] == "garden/bed_one")
    assert label["method"] is None and label["type"] == bed
    assert len({s["line"] for s in out["strings"] if s["value"] == "water the bed"}) == 2


def test_literals():
    text = r'''class A { string a = "x\ty\\\"\0", b = @"c:\d ""q""", c = $"n {1 + 2} m", d = """raw "text" here""", e = ""; char f = '"'; }'''
    values = [s["value"] for s in parsed(text)["strings"]]
    assert values[0] == 'x\ty\\"\0' and values[1] == 'c:\\d "q"' and values[-1] == "" and any("raw" in v for v in values)


def test_file_scoped_namespace_holds_for_all():
    assert [t["full_name"] for t in parsed("namespace A.B;\nclass C {}\nclass D { class E {} }")["types"]] == ["A.B.C", "A.B.D", "A.B.D.E"]


def test_generics_indexers_operators_events():
    out = parsed(
        """class A<T> : B<T>, C where T : new() {
        public T this[int i] { get { return x[i]; } set { } }
        public static A<T> operator +(A<T> a, A<T> b) => a;
        public event System.Action<int> Done;
        public Dictionary<string, List<T>> Map(Dictionary<int, T> a, params T[] rest) => null;
        (int, string) Pair() { return (1, "two"); }
        int? x, y = 3;
    }"""
    )
    assert out["parse_status"] == "OK"
    assert [p["name"] for p in out["properties"]] == ["this[]"]
    assert {"Map(Dictionary<int,T>,T[])", "Pair()"} <= {m["signature"] for m in out["methods"]}
    assert {f["name"] for f in out["fields"]} >= {"x", "y"}


def test_broken_sources():
    half = parsed(BROKEN)
    assert half["parse_status"] == "PARTIAL" and half["parse_error"] and [t["name"] for t in half["types"]] == ["Half"]
    none = parsed(NOTHING)
    assert none["parse_status"] == "FAILED" and none["parse_error"] and not none["types"]
    assert parse_source(b"")["parse_status"] == "OK"
    assert parse_source(b"\xff\xfe\x00class")["parse_status"] in ("OK", "PARTIAL", "FAILED")


@settings(max_examples=120, deadline=None)
@given(st.data())
def test_any_cut_of_a_source_ends(data):
    text = data.draw(st.sampled_from([SHAPES, HERBS]))
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(text)), st.integers(0, len(text)))))
    assert parsed(text[:a] + text[b:])["parse_status"] in ("OK", "PARTIAL", "FAILED")


def test_deep_nesting_ends():
    assert parsed("class A { int x = " + "(" * 3000 + "1" + ")" * 3000 + "; }")["parse_status"] in ("OK", "PARTIAL", "FAILED")
    assert parsed("class A { " * 1500)["parse_status"] in ("PARTIAL", "FAILED")

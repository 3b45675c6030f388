from vitaeloom.llm.graph import components
from vitaeloom.llm.names import Reader, candidates, link_names, name_classes, name_pairs, same_name, slipped, sounds
from vitaeloom.llm.strings import edits, jaro_winkler

SAME = [
    ["Torvalen Shipping", "Torvalen Shipping Inc.", "TORVALEN SHIPPING", "Shipping, Torvalen", "Torvalen Shpg", "Torvlaen Shipping", "Torvalen  Shipping (Remote)", "Torvalen Shipping, Lake Amsel", "TorvalenShipping", "Torvalen Shiping LLC"],
    ["Torvalen Insurance", "The Torvalen Insurance Group PLC", "Torvalen Insur."],
    ["Marek & Brindoval Foods", "Brindoval and Marek Foods GmbH"],
]
SCHOOLS = [["University of Keldavin", "Keldavin University", "U. of Keldavin", "Universidad de Keldavin", "Univ Keldavin", "University of Keldavim"], ["Keldavin Polytechnic", "École polytechnique de Keldavin", "Keldavin Poly"], ["Keldavin Institute of Music", "KIM - Keldavin Institute of Music", "Keldavin Inst. of Mus."]]


def linked(spark, rows):
    out: dict = {}
    for r in link_names(spark.createDataFrame(rows, "field string, name string, extra string")).collect():
        out.setdefault((r["field"], r["org"]), set()).add(r["name"])
    return sorted(map(sorted, out.values()))


def test_linking(spark):
    rows = [("company", n, "x") for g in SAME for n in g] * 2 + [("institution", n, None) for g in SCHOOLS for n in g] + [("company", None, ""), ("company", "  ", "")]
    assert linked(spark, rows) == sorted(map(sorted, SAME + SCHOOLS))


def test_pairs_are_ordered_and_stored(spark):
    df = link_names(spark.createDataFrame([("company", "b ltd", 1), ("company", "B Ltd", 2), ("company", "B Ltd", 3)], "field string, name string, name_a int"))
    assert [(r["name_a"], r["name_b"]) for r in name_pairs(df).collect()] == [("B Ltd", "b ltd")]
    assert link_names(spark.createDataFrame([], "field string, name string")).count() == 0


def test_hot_name_with_many_spellings(spark):
    rows = [("company", f"Torvalen Shipping{' ' * i}Inc", str(i)) for i in range(1, 300)]
    assert len(linked(spark, rows)) == 1


def test_measures():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and jaro_winkler("", "a") == 0 and jaro_winkler("a", "a") == 1
    assert (edits("abcd", "abdc", 2), edits("abc", "abc", 1), edits("abc", "xyz", 2), edits("", "ab", 2)) == (1, 0, 3, 2)
    assert same_name("brindoval marek", "brindovla marek", 0.8) and not same_name("brindoval", "brondaval", 0.8)
    assert Reader(False).read("Shipping") == ("", "shipping", "shipping")


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 6), (3, 1), (None, 4), *[(100 + i, 101 + i) for i in range(60)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[5] == 4 and got[6] == 6 and got[160] == 100
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


SLIPS = [["Hotgortaha Ener.", "Horgortaha Energy"], ["The Gaheobraka Networks Group", "Gahelbraka Networks"], ["Lignelpaga Robot.", "Lingelpaga Robotics PLC"], ["Pinsibnortin Optics", "Pinsinbortin Optics"]]


def test_slips_in_the_middle_of_a_name(spark):
    assert linked(spark, [("company", n, "") for g in SLIPS for n in g]) == sorted(map(sorted, SLIPS))


def one_slip(word):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in "abdmrz")
        yield from (word[:i] + c + word[i + 1 :] for c in "abdmrz" if i < len(word))
        yield word[:i] + word[i + 1 :]
        yield word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]


def test_blocks_hold_all_that_is_accepted(spark):
    cores = sorted({*one_slip("lingelpaga"), *one_slip("norpin"), *(f"{x} {y}" for x, y in zip(one_slip("bridge"), one_slip("waters"))), "bridgewaters", "bridgewater", "brid. wate.", "ling.", "lingelp.", "lingel", "nor"})
    ids = {c: i for i, c in enumerate(cores)}
    keys = spark.createDataFrame([("company", "foods", c, c.replace(" ", ""), i) for c, i in ids.items()], "field string, kind string, core string, run string, key bigint")
    got = {(cores[r["key"]], cores[r["key_b"]]) for r in candidates(keys).collect()}
    want = {(a, b) for a in cores for b in cores if ids[a] < ids[b] and (same_name(a, b, 0.8) or same_name(b, a, 0.8))}
    assert len(want) > 1_000 and want <= got


def test_names_cut_short_without_a_full_stop(spark):
    groups = [["Horstagel Energy", "Horstagelrin Energy"], ["Borzabrorg & Masulbrook Logistics", "Borzabrorgrin & Masulbrook Logistics"], ["Horst Energy"], ["Horstagel Foods"], ["Borzabrorg & Fenorbrook Logistics"]]
    assert linked(spark, [("company", n, "") for g in groups for n in g]) == sorted(map(sorted, groups))
    assert same_name("abcdef x", "abcdefghi x", 0.8) and not same_name("abcde x", "abcdefghi x", 0.8) and not same_name("abcdef xy", "abcdefghi x", 0.8)


def test_slips_that_reorder_tokens_and_long_short_forms(spark):
    groups = [["Borzabrorgrin & Masulbrook Logistics", "Orzabrorgrin & Masulbrook Logistics"], ["Bridgewater North Foods", "Ridgewater North Foods"], ["Torv. Optics", "Torvalenbrindoval Optics"]]
    assert linked(spark, [("company", n, "") for g in groups for n in g]) == sorted(map(sorted, groups))


def test_slips_in_words_that_are_left_out(spark):
    groups = [["The Brelvalelfa Software Group PLC", "Th Brelvalelfa Software Gruop Plc", "Brelvalelfa Software Pplc"], ["Keldavin Foods", "Keldavin Foods Ggmbh"], ["Ford Foods"]]
    assert linked(spark, [("company", n, "") for g in groups for n in g]) == sorted(map(sorted, groups))
    assert linked(spark, [("institution", n, "") for n in ("Keldavin Institute of Music", "keldavin institute oof music", "Keldavin Musicinstitute")]) == [sorted(["Keldavin Institute of Music", "keldavin institute oof music", "Keldavin Musicinstitute"])]


def test_names_run_together(spark):
    assert linked(spark, [("company", n, "") for n in ("Tor Valen Foods", "Torvalen Foods", "Valentor Foods")]) == [["Tor Valen Foods", "Torvalen Foods"], ["Valentor Foods"]]


def test_codes():
    assert sounds("torvalen") == "36145" and sounds("mann.") == "555" and sounds("aei") == "" and slipped("12") == ["12", "2", "1"]


def test_classes(spark):
    df = link_names(spark.createDataFrame([("company", n) for n in ("Torvalen Foods", "torvalen foods", "Torvalen Foods Ltd", "Kelda Foods", "Kelda Foods")], "field string, name string"))
    got = {r["name"]: (r["class_id"], r["links"]) for r in name_classes(df).collect()}
    assert [got[n][1] for n in ("Torvalen Foods", "torvalen foods", "Torvalen Foods Ltd", "Kelda Foods")] == [2, 2, 2, 0] and len({c for c, _ in got.values()}) == 2

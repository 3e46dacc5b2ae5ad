"""Values of the study's own stored tables, recomputed from its raw tables."""
import csv

import pytest
from pyspark.sql import functions as F

from quadrat.operators.change import composite_ratios, percent_change
from quadrat.operators.summary import mean_se
from quadrat.operators.wrangle import drop_columns, pivot, rename
from quadrat.plans.study import TIMES, conform
from quadrat.sources.tables import clean_keys, scan_tsv

IDS = ["Plot", "Block", "Treatment"]


def stored(path, first=None, last=None):
    lines = path.read_text().splitlines()[slice(first, last)]
    return list(csv.DictReader(lines, delimiter="\t"))


@pytest.fixture(scope="module")
def dims(spark, study):
    return {
        "samples": scan_tsv(spark, str(study["Sample lookup"]), "Plot int, lab_id int, SampDate string"),
        "plots": clean_keys(scan_tsv(spark, str(study["Plot lookup"]), "Plot string, Block string, Treatment string"), "Plot"),
        "periods": scan_tsv(spark, str(study["Period lookup"]), "SampDate string, GrazeTime string"),
    }


def by_plot(dims, sample_key):
    return [(dims["samples"], sample_key), (dims["plots"], ["Plot"]), (dims["periods"], ["SampDate"])]


CHEM = ["NO3_mgkgdrysoil", "NH4_mgkgdrysoil", "mineralN_mgkgdrysoil", "NPOC_mgkgdrysoil", "DON_mgkgdrysoil", "grav_mois"]


@pytest.fixture(scope="module")
def chemistry(spark, study, dims):
    raw = scan_tsv(spark, str(study["Chemistry, wide"]),
                   "lab_ID int, " + ", ".join(f"{c} double" for c in CHEM))
    return conform(raw, by_plot(dims, {"lab_ID": "lab_id"}), drop=["lab_ID", "SampDate"]).cache()


@pytest.fixture(scope="module")
def enzymes(spark, study, dims):
    raw = scan_tsv(spark, str(study["Enzymes, long"]),
                   "lab_ID int, Substrate string, Enzyme_nm_g_hr double, RunDay string")
    return conform(drop_columns(raw, "RunDay"), by_plot(dims, {"lab_ID": "lab_id"}),
                   drop=["lab_ID", "SampDate"]).cache()


def same_rows(df, path, digits=9):
    want = stored(path)
    names = list(want[0])
    assert sorted(df.columns) == sorted(names)

    def norm(v):
        try:
            return round(float(v), digits)
        except (TypeError, ValueError):
            return v

    got = sorted(str([norm(r[n]) for n in names]) for r in df.collect())
    assert got == sorted(str([norm(r[n]) for n in names]) for r in want)


def test_conformed_tables(spark, study, dims, chemistry, enzymes):
    same_rows(chemistry, study["Joined chemistry"])
    same_rows(enzymes, study["Joined enzymes"])
    moist = scan_tsv(spark, str(study["Moisture"]), "lab_ID int, grav_mois double, decimalgravmois double")
    moist = rename(drop_columns(moist, "grav_mois"), gravmois="decimalgravmois")
    same_rows(conform(moist, by_plot(dims, {"lab_ID": "lab_id"}), drop=["lab_ID", "SampDate"]), study["Joined moisture"])
    rpm = scan_tsv(spark, str(study["Biomass readings"]), "Plot int, SampDate string, reading_rpm double, biomass_kg_plot double")
    rpm = conform(rpm, by_plot(dims, {"Plot": "Plot", "SampDate": "SampDate"}), drop=["lab_id", "SampDate"])
    same_rows(rpm, study["Joined biomass"])


def test_nitrate_summary(study, chemistry):
    out = mean_se(chemistry.filter("Block != '4'"), ["Treatment", "GrazeTime"], {"NO3_mgkgdrysoil": "nitr"}, digits=3)
    same_rows(out, study["Group mean/SE"], 3)


def test_percent_change_summary(study, chemistry):
    change = percent_change(chemistry.filter("Block != '4'"), IDS, "GrazeTime", TIMES, "PRE",
                            ["DON_mgkgdrysoil", "grav_mois", "NH4_mgkgdrysoil", "NPOC_mgkgdrysoil"])
    out = mean_se(change, ["Treatment", "diffTimeSeries"],
                  {"DON_mgkgdrysoil": "DON", "grav_mois": "Grav", "NH4_mgkgdrysoil": "NH4", "NPOC_mgkgdrysoil": "DOC"})
    got = {(r["Treatment"], r["diffTimeSeries"]): r for r in out.collect()}
    want = stored(study["Percent change summary"])
    assert len(got) == len(want) == 9
    for w in want:
        row = got[w["Treatment"], w["diffTimeSeries"]]
        for name in w:
            if name not in ("Treatment", "diffTimeSeries"):
                assert row[name] == pytest.approx(float(w[name]), rel=1e-10)


ENZYMES = ["AG", "BG", "BX", "CBH", "LAP", "NAG", "PER1", "PEROX", "PHENOX", "PHOS"]


def enzyme_wide(enzymes, chemistry):
    rows = enzymes.filter("Block != '4'").join(chemistry, [*IDS, "GrazeTime"])
    wide = pivot(rows, [*IDS, "GrazeTime", "NPOC_mgkgdrysoil", "DON_mgkgdrysoil"], "Substrate", ENZYMES, ["Enzyme_nm_g_hr"])
    return composite_ratios(wide, ["AG", "BG", "BX", "CBH"], ["NAG", "LAP"], "PHOS", "NPOC_mgkgdrysoil", "DON_mgkgdrysoil")


def test_enzyme_change_summary(study, enzymes, chemistry):
    names = [e for e in ENZYMES if e != "PER1"]
    change = percent_change(enzyme_wide(enzymes, chemistry), IDS, "GrazeTime", TIMES, "PRE", names)
    out = mean_se(change, ["Treatment", "diffTimeSeries"], {n: f"_{n}" for n in names}, digits=2)
    same_rows(out, study["Enzyme percent change"], 2)


def test_raw_reader_marks_missing(spark, study):
    raw = scan_tsv(spark, str(study.with_column("Drywt")),
                   "Plot int, SampDate timestamp, Sample int, Drywt double, Bagwt double, DryMWt double")
    missing = raw.filter(F.col("Drywt").isNull() | F.col("Bagwt").isNull() | F.col("DryMWt").isNull())
    assert raw.count() == 120 and missing.count() == 60


def enzyme_changes(enzymes, chemistry):
    from quadrat.operators.wrangle import unpivot
    from quadrat.plans.study import change_with_baseline
    names = [*ENZYMES, "Ccycl", "Ncycl", "CNrat", "CP", "NP", "CDOC", "NDON", "CdocNdon"]
    long = unpivot(enzyme_wide(enzymes, chemistry), [*IDS, "GrazeTime"], names, "Type", "value")
    return change_with_baseline(long, [*IDS, "Type"], "GrazeTime", "value")


def test_enzyme_f_table(study, enzymes, chemistry):
    from quadrat.operators.models import anova
    got = {(r["Type"], r["term"]): r for r in anova(enzyme_changes(enzymes, chemistry), ["Type"], ["Time", "Treatment"], "value").collect()}
    want = stored(study["Sequential F table"])
    assert len(got) == len(want) == 54
    names = {"Time": "Time", "Treatment": "Treatment", "Interaction": "Time:Treatment"}
    for w in want:
        row = got[w["Type"], names[w["Comp"]]]
        assert row["fstat"] == pytest.approx(float(w["fstat"]), rel=1e-8)
        assert row["pval"] == pytest.approx(float(w["pval"]), abs=5.1e-4)


PARAMS = {"NPOC": "NPOC_mgkgdrysoil", "NH4": "NH4_mgkgdrysoil", "DON": "DON_mgkgdrysoil", "GravMois": "grav_mois"}


def test_stored_contrasts(study, chemistry):
    from quadrat.functions.semantics import shifted_log
    from quadrat.operators.models import emmeans_pairwise
    from quadrat.operators.wrangle import unpivot
    from quadrat.plans.study import change_with_baseline
    long = unpivot(chemistry.filter("Block != '4'"), [*IDS, "GrazeTime"], list(PARAMS.values()), "name", "value")
    data = change_with_baseline(long, [*IDS, "name"], "GrazeTime", "value").withColumn("logvalue", shifted_log("value"))
    times = ["diff_1WK", "diff_24H", "diff_4WK", "PRE"]
    by_time = emmeans_pairwise(data, ["name"], "Time", "Treatment", times, "logvalue").collect()
    by_trt = emmeans_pairwise(data, ["name"], "Treatment", "Time", ["HI", "LO", "NO"], "logvalue").collect()
    got_time = {(r["name"], r["contrast"], r["Treatment"]): r for r in by_time}
    got_trt = {(r["name"], r["contrast"], r["Time"]): r for r in by_trt}
    seen = 0
    for path, got, other in ((study["Contrasts over time"], got_time, "Treatment"),
                             (study["Contrasts over treatment"], got_trt, "Time")):
        for w in stored(path, 39, 130 if other == "Treatment" else 88):
            row = got.get((PARAMS.get(w["Param"]), w["contrast"], w[other]))
            if row is None:
                continue
            seen += 1
            assert row["estimate"] == pytest.approx(float(w["estimate"]), abs=1e-9)
            assert row["se"] == pytest.approx(float(w["SE"]), rel=1e-9)
            assert row["p"] == pytest.approx(float(w["p.value"]), abs=1e-9)
    assert seen >= 60

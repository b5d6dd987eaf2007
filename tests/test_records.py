"""The health-record study end to end, against the meaning of each step in plain loops."""

import datetime
import hashlib
import random
import statistics
from collections import Counter, defaultdict
from types import SimpleNamespace

import pytest

from check import rows_of
from matchweave.operators import models, wide
from matchweave.plans.records import RecordStudy, Settings
from matchweave.sources import schemas
from matchweave.sources.store import read_table, write_table

D = datetime.date
SETTINGS = Settings(stratum_cap=45, top_codes=12, kept_codes=8, codes_excluded=("ZZZZZ", "", "c03"), max_missing=0.97)


def make_tables(rng):
    """Persons, addresses, a GP log and hospital stays, with the dirt the study has to clean."""
    day = lambda a, b: D.fromordinal(rng.randrange(D(a, 1, 1).toordinal(), D(b, 12, 31).toordinal()))
    people = {}
    t = {name: [] for name in schemas.SCHEMAS}
    for p in range(1, 1001):
        born, sex = day(1940, 1943), rng.choice([1, 2])
        people[p] = (born, sex)
        t["persons"].append((p, 5000 + p, born, None, 8 if rng.random() < 0.01 else sex))
        moved = day(2012, 2021) if rng.random() < 0.3 else None
        quintile = lambda: rng.choice([1, 2])
        if moved is None:
            if rng.random() < 0.95:
                t["addresses"].append((p, D(2000, 1, 1), D(9999, 1, 1), quintile()))
        else:
            t["addresses"].append((p, D(2000, 1, 1), moved, quintile()))
            t["addresses"].append((p, moved + datetime.timedelta(1), D(9999, 1, 1), quintile()))
        if rng.random() < 0.05:
            t["deaths"].append((p, day(2020, 2021), "Valid", sex, None, 80))
        t["registrations"].append((p, D(2000, 1, 1), D(2021, 1, 1)))
        t["gp_patients"].append((p, 1, p, "Y" if rng.random() < 0.02 else None))
    t["deaths"] += [(None, D(2019, 1, 1), "Valid", 1, "x", 70), (7, None, "Invalid", 1, "x", 70)]
    common = [f"c{i:02d}" for i in range(20)]
    weights = list(range(20, 0, -1))
    outcome, broad = ["F110.", "Eu000"], ["E000."]

    def event(p, when, code, value):
        born, sex = people[p] if p else (D(1941, 5, 5), 1)
        if rng.random() < 0.01:
            sex = 3 - sex
        # A person's first record decides their control stratum, so records must not tie.
        t["gp_events"].append(
            (p, rng.randrange(9), p or 0, sex, born, "M", when, "2" if rng.random() < 0.95 else "3",
             code, value, "F", len(t["gp_events"]))
        )

    for p in range(1, 1001):
        for _ in range(rng.randrange(0, 40)):
            value = rng.choice([None, 0.0, float(rng.randrange(1, 9)), float(rng.randrange(1, 9))])
            when = day(2005, 2014)
            code = rng.choices(common, weights)[0]
            for _ in range(rng.choice([1, 1, 1, 2])):
                event(p, when, code, value)
        if rng.random() < 0.02:
            event(p, day(2008, 2018), rng.choice(broad), None)
        if rng.random() < 0.07:
            for _ in range(rng.choice([1, 2])):
                event(p, day(2012, 2021), rng.choice([*outcome, "13Y7.", "Eu002"]), None)
        if rng.random() < 0.3:
            for stay in range(rng.randrange(1, 3)):
                spell, start = p * 10 + stay, day(2010, 2020)
                person = None if rng.random() < 0.02 else p
                end = start + datetime.timedelta(rng.randrange(-2, 40))
                sex = rng.choice(["9", None]) if rng.random() < 0.05 else str(people[p][1])
                t["spells"].append(
                    ("H1", spell, person, sex, None, start, None, None if rng.random() < 0.05 else end,
                     rng.choice(["1", "4"]), None, None, None)
                )
                for e in range(1, rng.randrange(2, 4)):
                    stop = D(2999, 12, 31) if rng.random() < 0.01 else start + datetime.timedelta(rng.randrange(-1, 9))
                    age = rng.choice([None, -1, 130]) if rng.random() < 0.05 else start.year - people[p][0].year
                    t["episodes"].append(
                        ("H1", spell, e, None if rng.random() < 0.01 else start, stop, age,
                         None if rng.random() < 0.1 else "x", None if rng.random() < 0.5 else "op")
                    )
                    for n in range(1, rng.randrange(2, 5)):
                        code = rng.choice(["G300", "F002"]) if rng.random() < 0.12 else rng.choice(["I10", "J45"])
                        t["diagnoses"].append(("H1", None if rng.random() < 0.01 else spell, e, n, code))
    for _ in range(20):
        event(None, day(2010, 2018), rng.choice(outcome), None)
    for _ in range(40):
        event(rng.randrange(1, 1001), day(2005, 2010), rng.choice(["ZZZZZ", ""]), None)
    t["event_codes"] = [
        ("F110.", "Alzheimer's disease"), ("Eu000", "Dementia in Alzheimer's disease"),
        ("13Y7.", "Alzheimer's society member"), ("Eu002", "Dementia in Alzheimer's, atypical"),
        ("E000.", "Uncomplicated senile dementia"),
    ] + [(c, f"finding {c}") for c in common]
    t["diagnosis_codes"] = [
        ("G300", "Alzheimer's disease"), ("F002", "Dementia in Alzheimer's, mixed"),
        ("I10", "Hypertension"), ("J45", "Asthma"),
    ]
    return t


def approx_days(later, earlier, subtract="day"):
    """Days between two dates with years of 365 and months of 30 days."""
    last = earlier.day if subtract == "day" else earlier.month
    return (later.year - earlier.year) * 365 + (later.month - earlier.month) * 30 + later.day - last


def by_draw(person):
    return hashlib.md5(f"42|{person}".encode()).hexdigest()


class ByHand:
    """What each step of the study means, worked out person by person with plain loops."""

    def __init__(self, tables):
        rows = {n: [SimpleNamespace(**dict(zip(schemas.columns_of(n), r))) for r in t] for n, t in tables.items()}
        self.events, self.addresses = defaultdict(list), defaultdict(list)
        for e in rows["gp_events"]:
            if e.person is not None:
                self.events[e.person].append(e)
        for address in rows["addresses"]:
            self.addresses[address.person].append(address)
        self.outcome, self.outcome_icd = {"F110.", "Eu000"}, {"G300"}
        self.dementia = {"Eu000", "Eu002", "E000."}
        self.stays = self.hospital_stays(rows)
        self.dead = {d.person for d in rows["deaths"] if d.death_date_valid != "Invalid" and d.death_date}

    def hospital_stays(self, rows):
        """(episode, diagnosis, spell) of every outcome diagnosis, and the persons of usable spells."""
        spells = {}
        for s in rows["spells"]:
            dates = [d for d in (s.admit_date, s.discharge_date) if d]
            if s.spell is None or s.person is None or dates != sorted(dates):
                continue
            if all(1880 <= d.year <= 2022 for d in dates):
                spells[s.provider, s.spell] = s
        self.with_icd = {
            spells[d.provider, d.spell].person
            for d in rows["diagnoses"]
            if d.code in self.outcome_icd and (d.provider, d.spell) in spells
        }
        episodes = {}
        for e in rows["episodes"]:
            right = e.start_date and e.end_date >= e.start_date and e.end_date.year <= 2022
            if right and (e.age is None or 0 <= e.age <= 120) and (e.diag_codes or e.operation):
                episodes[e.provider, e.spell, e.episode] = e
        found = defaultdict(list)
        for d in rows["diagnoses"]:
            e, s = episodes.get((d.provider, d.spell, d.episode)), spells.get((d.provider, d.spell))
            if d.code in self.outcome_icd and e and s:
                found[s.person].append((e, d, s))
        return found

    def first_gp(self, person):
        """Index event of the practice records, if it lies in the study."""
        found = [e for e in self.events[person] if e.code in self.outcome]
        if not found:
            return None
        e = min(found, key=lambda e: (e.event_date, e.practice, e.local_num, e.sequence, e.code))
        age = approx_days(e.event_date, e.birth_date) // 365
        fits = 2015 <= e.event_date.year <= 2019 and 1870 <= e.birth_date.year <= 2003 and age >= 18
        return (e.event_date, age, e.sex, e.code) if fits else None

    def first_hospital(self, person):
        if person not in self.stays:
            return None
        e, d, s = min(
            self.stays[person], key=lambda x: (x[0].start_date, x[1].episode, x[1].diag_num, x[1].provider, x[1].spell)
        )
        left = s.discharge_date
        if left and ((s.discharge_method == "4" and left.year < 2015) or e.start_date > left):
            return None
        if not 2015 <= e.start_date.year <= 2019 or (e.age is not None and not 18 <= e.age <= 120):
            return None
        return e.start_date, e.age, int(s.sex) if s.sex in ("1", "2") else None, d.code

    def merged(self):
        out = []
        for person in sorted({*self.events, *self.stays}):
            gp, hospital = self.first_gp(person), self.first_hospital(person)
            both = [x for x in (gp, hospital) if x]
            if both:
                ages, sexes = ([x[i] for x in both if x[i] is not None] for i in (1, 2))
                out.append(
                    dict(
                        person=person,
                        sex=sexes[0] if sexes else None,
                        index_date=min(x[0] for x in both),
                        age=min(ages) if ages else None,
                        event_code=gp and gp[3],
                        diagnosis_code=hospital and hospital[3],
                    )
                )
        return out

    def cases(self):
        return [
            dict(m, quintile=a.quintile, label=1)
            for m in self.merged()
            for a in self.addresses[m["person"]]
            if a.start_date <= m["index_date"] <= a.end_date
        ]

    def chosen(self):
        counts = Counter(
            e.code
            for c in self.cases()
            for e in self.events[c["person"]]
            if e.sex == c["sex"] and approx_days(c["index_date"], e.event_date, "month") > 1825
        )
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12]
        return [dict(code=c, n=n) for c, n in top if c not in ("ZZZZZ", "", "c03")][:8]

    def drawn(self):
        strata = defaultdict(list)
        for person, events in self.events.items():
            homes = [a for a in self.addresses[person] if a.start_date.year < 2015 and a.end_date.year > 2019]
            usable = [e for e in events if 1870 < e.birth_date.year < 2001 and e.code_version == "2" and e.sex in (1, 2)]
            if homes and usable:
                e = min(usable, key=lambda e: (e.event_date, e.practice, e.local_num, e.sequence))
                strata[e.sex, homes[0].quintile, e.birth_date.year].append(person)
        return [
            dict(person=p, sex=sex, birth_year=year, quintile=quintile)
            for (sex, quintile, year), persons in strata.items()
            for p in sorted(persons, key=by_draw)[:45]
        ]

    def pool(self):
        cases, lists = {c["person"] for c in self.cases()}, self.dementia | self.outcome
        return [
            d
            for d in self.drawn()
            if d["person"] not in cases | self.dead | self.with_icd
            and not any(e.code in lists and e.sex == d["sex"] for e in self.events[d["person"]])
        ]

    def pairs(self, k=5):
        """Cases in turn, each taking the next controls of its stratum that are left."""
        stratum, left, out = ("sex", "birth_year", "quintile"), defaultdict(list), []
        for d in sorted(self.pool(), key=lambda d: by_draw(d["person"])):
            left[tuple(d[s] for s in stratum)].append(d["person"])
        for c in sorted(self.cases(), key=lambda c: by_draw(c["person"])):
            year = None if c["age"] is None else c["index_date"].year - c["age"]
            own = dict(sex=c["sex"], birth_year=year, quintile=c["quintile"])
            free = left[tuple(own.values())]
            for control in free[:k]:
                out.append(dict(case_person=c["person"], control_person=control, index_date=c["index_date"], **own))
            del free[:k]
        return out

    def grouped(self):
        pairs = self.pairs()
        sizes = Counter(p["case_person"] for p in pairs)
        number = {c: i for i, c in enumerate(sorted(c for c, n in sizes.items() if n == 5), 1)}
        return [dict(p, group_id=number[p["case_person"]]) for p in pairs if p["case_person"] in number]

    def members(self):
        out = {}
        for p in self.grouped():
            shared = {k: v for k, v in p.items() if not k.endswith("_person")}
            out[p["case_person"]] = dict(shared, person=p["case_person"], label=1)
            out[p["control_person"]] = dict(shared, person=p["control_person"], label=0)
        return list(out.values())

    def feats(self):
        codes, out = {c["code"] for c in self.chosen()}, []
        for m in self.members():
            old = defaultdict(list)
            for e in self.events[m["person"]]:
                if e.code in codes and approx_days(m["index_date"], e.event_date) >= 1825:
                    old[e.code].append(e)
            own = {k: v for k, v in m.items() if k != "index_date"}
            for code, events in old.items():
                first = min(e.event_date for e in events)
                values = [e.value for e in events if e.value is not None]
                mean = sum(values) / len(values) if values else None
                later = sum(e.event_date > first for e in events)
                out.append(dict(own, code=code, mean_value=mean or None, n_events=later + 1))
            if not old:
                out.append(dict(own, code="Z", mean_value=None, n_events=0))
        return out

    def balanced(self):
        groups, feats = defaultdict(set), self.feats()
        for f in feats:
            groups[f["group_id"]].add((-f["label"], f["person"]))
        kept = {p for members in groups.values() for _, p in sorted(members)[:2]}
        return [f for f in feats if f["person"] in kept]


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    tables = {}
    for name, rows in make_tables(random.Random(11)).items():
        path = str(folder / name)
        write_table(spark.createDataFrame(rows, schemas.SCHEMAS[name]).coalesce(2), path)
        tables[name] = read_table(spark, path, schemas.schema_of(name))
    return RecordStudy(tables, SETTINGS), folder


@pytest.fixture(scope="module")
def by_hand():
    return ByHand(make_tables(random.Random(11)))


STEPS = {
    "all_cases": "merged",
    "cases": "cases",
    "selected_codes": "chosen",
    "drawn": "drawn",
    "pool": "pool",
    "pairs": "pairs",
    "sets": "grouped",
    "members": "members",
    "features": "feats",
    "balanced_features": "balanced",
}


@pytest.mark.parametrize("step", STEPS)
def test_step_equals_plain_loops(study, by_hand, step):
    df, rows = getattr(study[0], step), getattr(by_hand, STEPS[step])()
    columns = sorted(rows[0])
    assert sorted(df.columns) == columns
    want = rows_of(columns, [tuple(r[c] for c in columns) for r in rows])
    assert rows_of(df.columns, df.collect()) == want and len(want) > 5


def test_cohort_checks_are_clean(study):
    checks = {r.check: r.n_violations for r in study[0].checks_of_cohort().collect()}
    assert len(checks) == 6 and set(checks.values()) == {0}


def test_ledger_adds_up(study):
    s = study[0]
    rows = sorted(s.exclusion_ledger().collect(), key=lambda r: r.step)
    assert rows[-1].n_left == s.pool.count()
    assert rows[0].n_removed + rows[0].n_left == s.drawn.count()


def test_quality_reports(study):
    reports = study[0].checks()
    nulls = {r.column_name: r.n_null for r in reports["nulls: deaths"].collect()}
    assert nulls["person"] == 1 and nulls["death_date"] == 1
    ranges = {r.column_name: (r.n_below, r.n_above) for r in reports["ranges: episodes"].collect()}
    assert ranges["age"][0] > 0 and ranges["age"][1] > 0
    assert reports["overlapping addresses"].count() == 0
    assert reports["repeated diagnosis codes"].count() > 0
    assert reports["repeated diagnosis numbers"].count() == 0
    assert reports["date order: episodes"].count() > 0
    for df in reports.values():
        df.count()


def test_wide_and_split(study):
    s = study[0]
    train, test = s.train_test()
    assert any(c.startswith("val_") for c in train.columns)
    model = models.fit(train, wide.feature_columns(train), models.tree(3))
    assert models.predict(model, test, ["person"]).count() == test.count()
    groups = {r[0] for r in train.select("group_id").distinct().collect()}
    others = {r[0] for r in test.select("group_id").distinct().collect()}
    assert not groups & others
    assert len(groups) == (len(groups) + len(others)) * 3 // 4
    assert train.count() + test.count() == s.members.count()
    assert s.wide(balanced=True).count() == 2 * (len(groups) + len(others))


def test_wide_without_value_columns(study):
    s = RecordStudy(study[0].tables, Settings(**{**SETTINGS.__dict__, "max_missing": 0.0}))
    assert not [c for c in s.wide().columns if c.startswith("val_")]


def test_contrast_equals_plain_loops(study, by_hand):
    groups = defaultdict(list)
    for f in by_hand.balanced():
        if f["code"] != "Z":
            groups[f["code"], f["label"]].append(f)
    want = []
    for (code, label), rows in groups.items():
        out = [code, label]
        for measure in ("mean_value", "n_events"):
            values = [r[measure] for r in rows if r[measure] is not None]
            out += [statistics.mean(values), statistics.median(values)] if values else [None, None]
        want.append(tuple(out))
    columns = ["code", "label", "mean_mean_value", "median_mean_value", "mean_n_events", "median_n_events"]
    got = study[0].contrast()
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want)


def test_reports_run(study):
    s = study[0]
    assert s.cases_dead_before().count() == 0
    assert s.described_codes().count() == s.selected_codes.count()
    assert s.stratum_sizes().count() > 0


def test_opt_outs_are_left_out(study):
    s = RecordStudy(study[0].tables, Settings(**{**SETTINGS.__dict__, "apply_opt_outs": True}))
    out = {r.person for r in s.opt_outs.collect()}
    assert out and not out & {r.person for r in s.pool.select("person").collect()}


def test_missing_columns_are_named(study):
    tables = dict(study[0].tables)
    tables["deaths"] = tables["deaths"].drop("age")
    del tables["spells"]
    with pytest.raises(ValueError, match="age"):
        RecordStudy(tables)

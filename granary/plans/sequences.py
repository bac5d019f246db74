"""Queries and oracles of E01-E15, F01-F13 and G01-G05."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.constants import CODE_LETTERS, CODE_RESIDUES, DNA_MASS, FLEXIBILITY, HYDROPATHY, NUCLEOTIDE_TEXT, PK, PROTEIN_TEXT, REPORT_TEXT, RESIDUE_MASS, WATER
from granary.operators import chromosomes as X
from granary.operators import nucleotide as N
from granary.operators import protein as P
from granary.operators import reports as R
from granary.plans.views import duck, v_prot, v_seq

R6 = lambda c: F.round(c, 6).alias(c)


def pair_weights(spark):
    """A dipeptide table made by a rule: the mean hydropathy of the pair. Published tables are passed in the same way."""
    one = spark.createDataFrame(list(HYDROPATHY.items()), "r string, h double")
    return one.crossJoin(one.select(F.col("r").alias("r2"), F.col("h").alias("h2"))).select(F.concat("r", "r2").alias("pair"), ((F.col("h") + F.col("h2")) / 2).alias("weight"))


def e08(s, d):
    return N.translate_six_frames(v_seq(s, d))


def e14(s, d):
    return N.describe_nucleotide(N.nucleotide_profile(v_seq(s, d))).select("seq_id", "description")


def profile(s, d):
    p = N.nucleotide_profile(v_seq(s, d))
    return p.select("seq_id", "length", *map(R6, ("gc_content", "gc_skew", "at_skew", "entropy")), F.round("dna_weight", 4).alias("dna_weight"), "longest_orf", "orf_count", "cpg_count", "repeat_count")


def _chunks(s, d):
    return X.chunk_sequences(v_seq(s, d), 1000)


def chunk_profile(s, d):
    p = X.nucleotide_profile(_chunks(s, d))
    return p.select("seq_id", "length", *map(R6, ("gc_content", "gc_skew", "at_skew", "entropy")), F.round("dna_weight", 4).alias("dna_weight"), "longest_orf", "orf_count", "cpg_count", "repeat_count")


def protein_profile(s, d, lang="en"):
    p = v_prot(s, d)
    for f in (P.protein_weight, P.isoelectric_point, P.gravy, P.secondary_structure, P.aromaticity, P.ptm_counts):
        p = f(p)
    return P.describe_protein(P.instability_index(p, pair_weights(s)), lang)


def report(s, d):
    p = N.describe_nucleotide(N.nucleotide_profile(v_seq(s, d)))
    return R.sequence_markdown(p).select("file", "part", F.md5("markdown").alias("markdown_md5"))


def nucleotide_json(s, d):
    """What the JSON of each sequence says, read back from it."""
    j = R.sequence_json(N.describe_nucleotide(R.with_details(N.nucleotide_profile(v_seq(s, d)))))
    at = lambda path, kind="string": F.get_json_object("json", f"$.{path}").cast(kind)
    return j.select(
        "seq_id", F.array_join(F.json_object_keys("json"), ",").alias("keys"), at("name").alias("name"), F.round(at("analysis.gc_content", "double"), 6).alias("gc"), at("analysis.orf_count", "long").alias("orfs"),
        F.json_array_length(at("top_orfs")).cast("long").alias("top"), at("top_orfs[0].start", "long").alias("first_start"), F.json_array_length(at("cpg_islands")).cast("long").alias("islands"), F.md5(at("sequence")).alias("sequence_md5"),
    )


def protein_json(s, d):
    p = v_prot(s, d).withColumns({"sequence_type": F.lit("protein"), "length": F.length("sequence").cast("long")})
    for f in (P.gravy, P.secondary_structure, P.residue_classes, P.ptm_counts):
        p = f(p)
    j = R.sequence_json(P.stability_class(P.instability_index(p, pair_weights(s))), include_full=False)
    at = lambda path, kind: F.get_json_object("json", f"$.{path}").cast(kind)
    return j.select(
        "seq_id", F.array_join(F.json_object_keys("json"), ",").alias("keys"), F.round(at("analysis.gravy", "double"), 6).alias("gravy"), F.round(at("secondary_structure.helix", "double"), 6).alias("helix"),
        F.round(at("amino_acid_classes.polar", "double"), 6).alias("polar"), at("ptm_sites_summary.phosphorylation_count", "long").alias("phosphorylation"),
    )


QUERIES = {
    "e01_detect_type": lambda s, d: N.detect_type(v_prot(s, d)).select("seq_id", "sequence_type"),
    "e02_composition": lambda s, d: N.composition(v_seq(s, d)).select("seq_id", F.inline("composition")),
    "e03_gc_content": lambda s, d: N.gc_content(v_seq(s, d)).select("seq_id", R6("gc_content")),
    "e04_gc_skew": lambda s, d: N.gc_skew(v_seq(s, d)).select("seq_id", R6("gc_skew")),
    "e05_at_skew": lambda s, d: N.at_skew(v_seq(s, d)).select("seq_id", R6("at_skew")),
    "e06_find_orfs": lambda s, d: N.find_orfs(v_seq(s, d)),
    "e06_orfs_of_chunks": lambda s, d: X.find_orfs(_chunks(s, d)),
    "e11_runs_of_chunks": lambda s, d: X.tandem_runs(_chunks(s, d)),
    "e11_repeats_of_chunks": lambda s, d: X.tandem_repeats(_chunks(s, d)),
    "e12_islands_of_chunks": lambda s, d: X.cpg_islands(_chunks(s, d)).select("seq_id", "start", "end", R6("gc_content"), R6("cpg_ratio")),
    "e15_profile_of_chunks": chunk_profile,
    "e07_orf_summary": lambda s, d: N.orf_summary(N.find_orfs(v_seq(s, d))).select("seq_id", "longest", "orfs", F.array_join(F.transform("top", lambda x: x["start"].cast("string")), ",").alias("top")),
    "e08_translate_six_frames": e08,
    "e09_reverse_complement": lambda s, d: v_seq(s, d).select("seq_id", F.md5(N.reverse_complement("sequence")).alias("rc_md5")),
    "e10_entropy": lambda s, d: N.entropy(v_seq(s, d)).select("seq_id", R6("entropy")),
    "e11_tandem_runs": lambda s, d: N.tandem_runs(v_seq(s, d)),
    "e11_tandem_repeats": lambda s, d: N.tandem_repeats(v_seq(s, d)),
    "e12_cpg_islands": lambda s, d: N.cpg_islands(v_seq(s, d)).select("seq_id", "start", "end", R6("gc_content"), R6("cpg_ratio")),
    "e13_dna_weight": lambda s, d: N.dna_weight(v_seq(s, d)).select("seq_id", F.round("dna_weight", 4).alias("dna_weight")),
    "e14_describe_nucleotide": e14,
    "e15_nucleotide_profile": profile,
    "f01_protein_weight": lambda s, d: P.protein_weight(v_prot(s, d)).select("seq_id", F.round("protein_weight", 4).alias("protein_weight")),
    "f02_aromaticity": lambda s, d: P.aromaticity(v_prot(s, d)).select("seq_id", R6("aromaticity")),
    "f03_instability_index": lambda s, d: P.instability_index(v_prot(s, d), pair_weights(s)).select("seq_id", R6("instability_index")),
    "f04_isoelectric_point": lambda s, d: P.isoelectric_point(v_prot(s, d)).select("seq_id", F.round("isoelectric_point", 2).alias("isoelectric_point")),
    "f05_residue_percent": lambda s, d: P.residue_percent(v_prot(s, d)).select("seq_id", F.explode_outer("residue_percent").alias("residue", "share")).select("seq_id", "residue", R6("share")),
    "f06_secondary_structure": lambda s, d: P.secondary_structure(v_prot(s, d)).select("seq_id", R6("helix"), R6("turn"), R6("sheet")),
    "f07_gravy": lambda s, d: P.gravy(v_prot(s, d)).select("seq_id", R6("gravy")),
    "f08_flexibility_mean": lambda s, d: P.flexibility_mean(v_prot(s, d)).select("seq_id", R6("flexibility_mean")),
    "f09_stability_class": lambda s, d: P.stability_class(P.instability_index(v_prot(s, d), pair_weights(s))).select("seq_id", "stability_class"),
    "f10_charge_at_ph": lambda s, d: P.charge_at_ph(v_prot(s, d)).select("seq_id", F.col("charge").cast("double").alias("charge")),
    "f11_residue_classes": lambda s, d: P.residue_classes(v_prot(s, d)).select("seq_id", *map(R6, ("hydrophobic", "polar", "positive", "negative", "aromatic"))),
    "f12_ptm_sites": lambda s, d: P.ptm_sites(v_prot(s, d)),
    "f13_describe_protein": lambda s, d: protein_profile(s, d).select("seq_id", "description"),
    "f13_describe_protein_zh": lambda s, d: protein_profile(s, d, "zh").select("seq_id", "description"),
    "g01_collection_stats": lambda s, d: R.collection_stats(v_seq(s, d)).withColumn("avg_length", F.round("avg_length", 6)),
    "g02_sequence_preview": lambda s, d: R.sequence_preview(v_seq(s, d)).select("seq_id", "preview"),
    "g03_collection_summary": lambda s, d: R.collection_summary(R.collection_stats(v_seq(s, d))).select("file", "summary"),
    "g04_sequence_json": nucleotide_json,
    "g04_protein_json": protein_json,
    "g04_collection_json": lambda s, d: R.collection_json(v_seq(s, d).withColumn("length", F.length("sequence"))).select("file", F.get_json_object("json", "$.total_count").cast("long").alias("n"), F.get_json_object("json", "$.total_length").cast("long").alias("total"), F.get_json_object("json", "$.bioinformatics_features[7]").alias("last")),
    "g05_sequence_markdown": report,
}


def _n(letters: str, col: str = "sequence") -> str:
    return f"(length({col}) - length(translate({col}, '{letters}', '')))"


def _weights(table: dict[str, float]) -> str:
    return " + ".join(f"{_n(k)} * {v}" for k, v in table.items())


def _share(letters: str) -> str:
    return f"{_n(letters)} / nullif(length(sequence), 0)"


def _skew(a: str, b: str) -> str:
    return f"({_n(a)} - {_n(b)}) / nullif({_n(a)} + {_n(b)}, 0)"


_ORFS = """with c as (select seq_id, pos, pos % 3 frame, substr(sequence, pos + 1, 3) codon from (select seq_id, sequence, unnest(range(0, length(sequence) - 2)) pos from v_seq) where substr(sequence, pos + 1, 3) in ('ATG', 'TAA', 'TAG', 'TGA')),
w as (select *, min(case when codon <> 'ATG' then pos end) over (partition by seq_id, frame order by pos rows between 1 following and unbounded following) stop from c),
o as (select seq_id, pos "start", stop + 3 "end", stop + 3 - pos length, frame, '+' strand from w where codon = 'ATG' and stop is not null and stop + 3 - pos >= 100) """
_RUNS = """with m as (select seq_id, l period, i from (select seq_id, sequence, l, unnest(range(0, length(sequence) - l)) i from (select seq_id, sequence, unnest(range(10, least(50, length(sequence) // 3) + 1)) l from v_seq)) where substr(sequence, cast(i + 1 as bigint), 1) = substr(sequence, cast(i + l + 1 as bigint), 1)),
g as (select *, i - row_number() over (partition by seq_id, period order by i) grp from m),
r as (select seq_id, period, min(i) "start", count(*) matches from g group by seq_id, period, grp having count(*) >= period) """
_CPG = f"""with w as (select seq_id, s "start", substr(sequence, cast(s + 1 as bigint), 200) w from (select seq_id, sequence, unnest(range(0, length(sequence) - 200, 50)) s from v_seq where length(sequence) > 200)),
k as (select seq_id, "start", {_n('GC', 'w')} / 200 gc_content, (length(w) - length(replace(w, 'CG', ''))) // 2 cg, {_n('C', 'w')} * {_n('G', 'w')} / 200 expected from w),
i as (select seq_id, "start", "start" + 200 "end", round(gc_content, 6) gc_content, round(cg / nullif(expected, 0), 6) cpg_ratio from k where gc_content >= 0.6 and cg > 0 and cg / nullif(expected, 0) >= 0.6) """
_ENTROPY = """with ch as (select seq_id, unnest(string_split(sequence, '')) c from v_seq), n as (select seq_id, c, count(*) n from ch where c <> '' group by 1, 2),
e as (select seq_id, 0 - sum(n / t * log2(n / t)) entropy from (select *, sum(n) over (partition by seq_id) t from n) group by 1) """
_CODONS = ", ".join(f"('{a}{b}{c}', '{CODE_RESIDUES[16 * i + 4 * j + k]}')" for i, a in enumerate(CODE_LETTERS) for j, b in enumerate(CODE_LETTERS) for k, c in enumerate(CODE_LETTERS))
_RC = "translate(reverse(sequence), 'ACGT', 'TGCA')"
_FRAMES = f"""with s as (select seq_id, 'forward' direction, sequence q from v_seq union all select seq_id, 'reverse', {_RC} from v_seq),
f as (select seq_id, direction, f + 1 frame, substr(q, cast(f + 1 as bigint)) q from s, range(0, 3) t(f)),
code(codon, aa) as (values {_CODONS}),
c as (select seq_id, direction, frame, i, substr(q, cast(3 * i + 1 as bigint), 3) codon from (select *, unnest(range(0, length(q) // 3)) i from f)),
p as (select seq_id, direction, frame, string_agg(aa, '' order by i) p from c join code using (codon) group by 1, 2, 3),
a as (select f.seq_id, f.direction, f.frame, coalesce(p, '') p from f left join p using (seq_id, direction, frame))
select seq_id, direction, cast(frame as bigint) frame, case when strpos(p, '*') > 0 then substr(p, 1, strpos(p, '*') - 1 + 10) else substr(p, 1, 200) end peptide from a"""
_PAIR = "(select a.r || b.r pair, (a.h + b.h) / 2 weight from hyd a, hyd b)"
_INSTABILITY = f"""with hyd(r, h) as (values {", ".join(f"('{k}', cast({v} as double))" for k, v in HYDROPATHY.items())}),
pr as (select seq_id, substr(sequence, cast(k as bigint), 2) pair from (select seq_id, sequence, unnest(range(1, length(sequence))) k from v_prot)),
t as (select seq_id, sum(weight) total from pr join {_PAIR} using (pair) group by 1),
x as (select v.seq_id, 10 * coalesce(total, 0) / nullif(length(sequence), 0) instability_index from v_prot v left join t using (seq_id)) """
_CHARGE = " + ".join(f"{'1' if name.endswith('-term') else 'n_' + name} * {sign} / (1 + pow(10, {sign} * (ph - {pk})))" for name, pk, sign in PK)
_FLEX = "case c " + " ".join(f"when '{k}' then {v}" for k, v in FLEXIBILITY.items()) + " else 0.0 end"
_ASCII = "regexp_replace({}, '[^S]', '', 'g')"

_T = NUCLEOTIDE_TEXT["en"]
_DESCRIBE = f"""select seq_id, concat_ws('; ',
  case when 100 * g < 30 then printf('{_T['gc_lowest']}', round(100 * g + 1e-9, 1)) when 100 * g < 40 then printf('{_T['gc_low']}', round(100 * g + 1e-9, 1)) when 100 * g > 70 then printf('{_T['gc_highest']}', round(100 * g + 1e-9, 1)) when 100 * g > 60 then printf('{_T['gc_high']}', round(100 * g + 1e-9, 1)) else printf('{_T['gc_middle']}', round(100 * g + 1e-9, 1)) end,
  case when abs(gc_skew) > 0.15 then printf('{_T['skew']}', sign(gc_skew) * round(abs(gc_skew) + 1e-9, 2), case when gc_skew > 0 then 'positive' else 'negative' end) end,
  case when longest_orf >= 1000 then printf('{_T['orf_longest']}', longest_orf) when longest_orf >= 300 then printf('{_T['orf_long']}', longest_orf) when longest_orf >= 100 then printf('{_T['orf_middle']}', longest_orf) end,
  case when longest_orf >= 300 and longest_orf < 1000 and orf_count > 1 then printf('{_T['orf_many']}', orf_count) end,
  case when cpg_count > 3 then printf('{_T['cpg_many']}', cpg_count) when cpg_count >= 1 then printf('{_T['cpg']}', cpg_count) end,
  case when repeat_count > 5 then printf('{_T['repeats_many']}', repeat_count) when repeat_count >= 1 then printf('{_T['repeats']}', repeat_count) end,
  case when entropy < 1.0 then '{_T['complexity_lowest']}' when entropy < 1.5 then '{_T['complexity_low']}' when entropy > 1.9 then '{_T['complexity_high']}' end) || '.' description
from (select *, coalesce(gc_content, 0) g from profile)"""
_REPEATS = """, st as (select r.seq_id, period, "start", matches, unnest(range("start", "start" + matches - period + 1)) p from r),
u as (select st.seq_id, period, p, substr(sequence, cast(p + 1 as bigint), cast(period as bigint)) unit, ("start" + matches - p) // period + 1 c from st join v_seq using (seq_id)),
d as (select * from u qualify row_number() over (partition by seq_id, unit order by p) = 1),
k as (select *, row_number() over (partition by seq_id order by period desc, p) k from d qualify k <= 15),
rep as (select seq_id, row_number() over (partition by seq_id order by period * c desc, k) rank, p "position", period length, c repeat_count, case when length(unit) > 30 then substr(unit, 1, 30) || '...' else unit end pattern from k) """


def _profile_sql(select: str) -> str:
    body = _ORFS + ", " + _RUNS.removeprefix("with ") + _REPEATS + ", " + _CPG.removeprefix("with ").replace("w as (", "cw as (").replace("from w)", "from cw)").replace("k as (", "ck as (").replace("from k ", "from ck ") + ", " + _ENTROPY.removeprefix("with ").replace("n as (", "en as (").replace("from n)", "from en)")
    body += f""", profile as (select v.seq_id, length(sequence) length, {_n('GC')} / nullif({_n('ACGT')}, 0) gc_content, {_skew('G', 'C')} gc_skew, {_skew('A', 'T')} at_skew,
  coalesce(e.entropy, 0) entropy, case when length(sequence) > 0 then {_weights(DNA_MASS)} - (length(sequence) - 1) * {WATER} end dna_weight,
  coalesce(longest_orf, 0) longest_orf, coalesce(orf_count, 0) orf_count, coalesce(cpg_count, 0) cpg_count, coalesce(repeat_count, 0) repeat_count
  from v_seq v left join e using (seq_id) left join (select seq_id, max(length) longest_orf, count(*) orf_count from o group by 1) using (seq_id)
  left join (select seq_id, count(*) cpg_count from i group by 1) using (seq_id) left join (select seq_id, count(*) repeat_count from rep group by 1) using (seq_id)) """
    return duck(body + select, "v_seq")


_PI = f"""c as (select seq_id, {', '.join(f"{_n(n)} n_{n}" for n, _, _ in PK if not n.endswith('-term'))} from v_prot where length(sequence) > 0),
g as (select seq_id, ph, round(abs({_CHARGE}), 9) off from c, (select k * 0.01::double ph from range(0, 1401) t(k))), b as (select seq_id, arg_min(ph, (off, ph)) isoelectric_point from g group by 1)"""


def _protein_sql(lang: str) -> str:
    t = PROTEIN_TEXT[lang]
    rounded = lambda value, n: f"round({value} + sign({value}) * 1e-9, {n})"
    say = lambda key, *values: f"printf('{t[key]}', {', '.join(values)})"
    clauses = [
        [("kda > 100", "mass_large", "kda", 1), ("kda < 10", "mass_small", "kda", 1), ("kda > 0", "mass", "kda", 1)],
        [("i < 25", "stable_very", "i", 1), ("i < 40", "stable", "i", 1), ("i >= 40", "unstable", "i", 1)],
        [("pi < 5", "pi_lowest", "pi", 2), ("pi < 6", "pi_low", "pi", 2), ("pi > 9", "pi_highest", "pi", 2), ("pi > 8", "pi_high", "pi", 2), ("pi is not null", "pi_middle", "pi", 2)],
        [("g > 0.5", "gravy_highest", "g", 2), ("g > 0", "gravy_high", "g", 2), ("g < -0.5", "gravy_lowest", "g", 2), ("g is not null", "gravy_low", "g", 2)],
        [("helix > 40", "helix_rich", "helix", 1), ("sheet > 30", "sheet_rich", "sheet", 1)],
        [("rings > 15", "aromatic", "rings", 1)],
    ]
    text = [[f"when {test} then {say(key, rounded(value, n))}" for test, key, value, n in c] for c in clauses]
    text[4].append(f"when helix is not null then {say('structure', rounded('helix', 1), rounded('sheet', 1))}")
    text += [[f"when phos > 10 then {say('phospho_many', 'phos')}", f"when phos > 0 then {say('phospho', 'phos')}"], [f"when glyco > 0 then {say('glyco', 'glyco')}"]]
    cases = ", ".join("case " + " ".join(c) + " end" for c in text)
    return duck(
        _INSTABILITY + f""", {_PI}, q as (select v.seq_id, case when length(sequence) > 0 then ({_weights(RESIDUE_MASS)} - (length(sequence) - 1) * {WATER}) / 1000 end kda, instability_index i, isoelectric_point pi,
({_weights(HYDROPATHY)}) / nullif(length(sequence), 0) g, 100 * {_share('EMALK')} helix, 100 * {_share('VIYFWLT')} sheet, 100 * {_share('FWY')} rings, least({_n('STY')}, 15) phos,
least(len(list_filter(range(1, length(sequence) - 1), lambda k: substr(sequence, k, 1) = 'N' and substr(sequence, k + 1, 1) <> 'P' and substr(sequence, k + 2, 1) in ('S', 'T'))), 15) glyco
from v_prot v left join x using (seq_id) left join b using (seq_id)) select seq_id, concat_ws('{t['separator']}', {cases}) || '{t['end']}' description from q""",
        "v_prot",
    )


_RT = REPORT_TEXT["en"]
_REPORT = f"""select file, 0::bigint part, md5('# {_RT['title']}' || chr(10) || chr(10) || '## 📊 {_RT['statistics']}' || chr(10) || chr(10) || '- **{_RT['count']}**: ' || count(*) || chr(10) || '- **{_RT['total']}**: ' || format('{{:,}}', cast(sum(length(sequence)) as bigint)) || ' bp' || chr(10)
  || '- **{_RT['average']}**: ' || cast(cast(round_even(avg(length(sequence)), 0) as bigint) as varchar) || ' bp' || chr(10) || '- **{_RT['shortest']}**: ' || format('{{:,}}', min(length(sequence))) || ' bp' || chr(10) || '- **{_RT['longest']}**: ' || format('{{:,}}', max(length(sequence))) || ' bp'
  || chr(10) || chr(10) || '## 🧬 {_RT['details']}' || chr(10)) markdown_md5 from v_seq group by 1
union all select file, part, md5(concat_ws(chr(10), '### ' || part || '. ' || seq_id || chr(10), '**Description**: ' || seq_id || chr(10), '**Length**: ' || format('{{:,}}', length(sequence)) || ' bp' || chr(10),
  '**{_RT['preview']}**:' || chr(10) || '```' || chr(10) || case when length(sequence) > 100 then substr(sequence, 1, 100) || '...' else sequence end || chr(10) || '```' || chr(10),
  '**🔬 {_RT['meaning']}**:' || chr(10) || description || chr(10), printf('**{_RT['gc']}**: %.2f%%', round(gc_content * 100 + 1e-9, 2)), case when longest_orf > 0 then '**{_RT['orf']}**: ' || longest_orf || ' bp' end,
  case when cpg_count > 0 then '**{_RT['cpg']}**: ' || cpg_count end, case when entropy > 0 then printf('**{_RT['complexity']}**: %.2f', round(entropy + 1e-9, 2)) end, ''))
from (select p.*, file, sequence, description, row_number() over (partition by file order by seq_id) part from profile p join v_seq using (seq_id) join ({_DESCRIBE}) using (seq_id))"""


ORACLES = {
    "e01_detect_type": duck(f"select seq_id, case when {_share('ATCGUN')} > 0.85 then 'nucleotide' else 'protein' end sequence_type from v_prot", "v_prot"),
    "e02_composition": duck("select seq_id, c letter, count(*) n from (select seq_id, unnest(string_split(sequence, '')) c from v_seq) where c <> '' group by 1, 2", "v_seq"),
    "e03_gc_content": duck(f"select seq_id, round({_n('GC')} / nullif({_n('ACGT')}, 0), 6) gc_content from v_seq", "v_seq"),
    "e04_gc_skew": duck(f"select seq_id, round({_skew('G', 'C')}, 6) gc_skew from v_seq", "v_seq"),
    "e05_at_skew": duck(f"select seq_id, round({_skew('A', 'T')}, 6) at_skew from v_seq", "v_seq"),
    "e06_find_orfs": duck(_ORFS + "select * from o", "v_seq"),
    "e07_orf_summary": duck(_ORFS + """select seq_id, max(length) longest, count(*) orfs, string_agg("start", ',' order by frame, "start") filter (where k <= 5) top from (select *, row_number() over (partition by seq_id order by frame, "start") k from o) group by 1""", "v_seq"),
    "e08_translate_six_frames": duck(_FRAMES, "v_seq"),
    "e09_reverse_complement": duck(f"select seq_id, md5({_RC}) rc_md5 from v_seq", "v_seq"),
    "e10_entropy": duck(_ENTROPY + "select v.seq_id, round(coalesce(entropy, 0), 6) entropy from v_seq v left join e using (seq_id)", "v_seq"),
    "e11_tandem_runs": duck(_RUNS + "select * from r", "v_seq"),
    "e11_tandem_repeats": duck(_RUNS + _REPEATS + "select * from rep", "v_seq"),
    "e12_cpg_islands": duck(_CPG + "select * from i", "v_seq"),
    "e13_dna_weight": duck(f"select seq_id, case when length(sequence) > 0 then round({_weights(DNA_MASS)} - (length(sequence) - 1) * {WATER}, 4) end dna_weight from v_seq", "v_seq"),
    "e14_describe_nucleotide": _profile_sql(_DESCRIBE),
    "e15_nucleotide_profile": _profile_sql("select seq_id, length, round(gc_content, 6) gc_content, round(gc_skew, 6) gc_skew, round(at_skew, 6) at_skew, round(entropy, 6) entropy, round(dna_weight, 4) dna_weight, longest_orf, orf_count, cpg_count, repeat_count from profile"),
    "f01_protein_weight": duck(f"select seq_id, case when length(sequence) > 0 then round({_weights(RESIDUE_MASS)} - (length(sequence) - 1) * {WATER}, 4) end protein_weight from v_prot", "v_prot"),
    "f02_aromaticity": duck(f"select seq_id, round({_share('FWY')}, 6) aromaticity from v_prot", "v_prot"),
    "f03_instability_index": duck(_INSTABILITY + "select seq_id, round(instability_index, 6) instability_index from x", "v_prot"),
    "f04_isoelectric_point": duck(f"""with c as (select seq_id, {', '.join(f"{_n(n)} n_{n}" for n, _, _ in PK if not n.endswith('-term'))} from v_prot where length(sequence) > 0),
g as (select seq_id, ph, round(abs({_CHARGE}), 9) off from c, (select k * 0.01::double ph from range(0, 1401) t(k))),
b as (select seq_id, round(arg_min(ph, (off, ph)), 2) isoelectric_point from g group by 1) select v.seq_id, isoelectric_point from v_prot v left join b using (seq_id)""", "v_prot"),
    "f05_residue_percent": duck(" union all ".join(f"select seq_id, '{r}' residue, round({_share(r)}, 6) \"share\" from v_prot" for r in RESIDUE_MASS), "v_prot"),
    "f06_secondary_structure": duck(f"select seq_id, round({_share('EMALK')}, 6) helix, round({_share('NPGS')}, 6) turn, round({_share('VIYFWLT')}, 6) sheet from v_prot", "v_prot"),
    "f07_gravy": duck(f"select seq_id, round(({_weights(HYDROPATHY)}) / nullif(length(sequence), 0), 6) gravy from v_prot", "v_prot"),
    "f08_flexibility_mean": duck(f"""with r as (select seq_id, p, {_FLEX} x from (select seq_id, p, substr(sequence, cast(p as bigint), 1) c from (select seq_id, sequence, unnest(range(1, length(sequence) + 1)) p from v_prot))),
w as (select seq_id, ({' + '.join(f"{1 - 0.1875 * abs(k)} * {'x' if not k else f'lead(x, {k}) over o' if k > 0 else f'lag(x, {-k}) over o'}" for k in range(-4, 5))}) / 5.25 s from r window o as (partition by seq_id order by p))
select v.seq_id, round(coalesce(m, 0), 6) flexibility_mean from v_prot v left join (select seq_id, avg(s) m from w group by 1) using (seq_id)""", "v_prot"),
    "f09_stability_class": duck(_INSTABILITY + "select seq_id, case when instability_index < 40 then 'stable' when instability_index >= 40 then 'unstable' end stability_class from x", "v_prot"),
    "f10_charge_at_ph": duck(f"select seq_id, cast({_n('KR')} - {_n('DE')} as double) charge from v_prot", "v_prot"),
    "f11_residue_classes": duck("select seq_id, " + ", ".join(f"round(coalesce({_share(v)}, 0), 6) {k}" for k, v in {"hydrophobic": "AVILMFWP", "polar": "STNQ", "positive": "KRH", "negative": "DE", "aromatic": "FWY"}.items()) + " from v_prot", "v_prot"),
    "f12_ptm_sites": duck("""with r as (select seq_id, sequence, p, substr(sequence, cast(p as bigint), 1) c, substr(sequence, cast(p + 1 as bigint), 1) n1, substr(sequence, cast(p + 2 as bigint), 1) n2 from (select seq_id, sequence, unnest(range(1, length(sequence) + 1)) p from v_prot)),
k as (select *, case when c in ('S', 'T', 'Y') then 'phosphorylation' when c = 'K' then 'acetylation' when c = 'N' and n1 not in ('', 'P') and n2 in ('S', 'T') then 'glycosylation' end kind from r)
select seq_id, kind, p "position", c residue, substr(sequence, cast(greatest(p - 2, 1) as bigint), cast(p + 3 - greatest(p - 2, 1) as bigint)) context,
  case when kind = 'glycosylation' then substr(sequence, cast(p as bigint), 3) end motif, case when kind = 'phosphorylation' then case when n1 = 'P' then 2.0::double else 1.0::double end end score
from k where kind is not null qualify row_number() over (partition by seq_id, kind order by p) <= 15""", "v_prot"),
    "f13_describe_protein": _protein_sql("en"),
    "f13_describe_protein_zh": _protein_sql("zh"),
    "g05_sequence_markdown": _profile_sql(_REPORT),
    "g01_collection_stats": duck("select file, count(*) n, cast(sum(length(sequence)) as bigint) total_length, round(avg(length(sequence)), 6) avg_length, min(length(sequence)) min_length, max(length(sequence)) max_length from v_seq group by 1", "v_seq"),
    "g02_sequence_preview": duck("select seq_id, case when length(sequence) > 100 then substr(sequence, 1, 100) || '...' else sequence end preview from v_seq", "v_seq"),
    "g03_collection_summary": duck("select file, printf('Contains %d biological sequence(s), total length %s bp', count(*), format('{:,}', cast(sum(length(sequence)) as bigint))) summary from v_seq group by 1", "v_seq"),
}

# chunks change nothing
ORACLES |= {"e06_orfs_of_chunks": ORACLES["e06_find_orfs"], "e11_runs_of_chunks": ORACLES["e11_tandem_runs"], "e11_repeats_of_chunks": ORACLES["e11_tandem_repeats"], "e12_islands_of_chunks": ORACLES["e12_cpg_islands"], "e15_profile_of_chunks": ORACLES["e15_nucleotide_profile"]}
ORACLES["g04_collection_json"] = duck("select file, count(*) n, cast(sum(length(sequence)) as bigint) total, 'semantic_description' as last from v_seq group by 1", "v_seq")
_TOP = "t as (select seq_id, least(count(*), 5) top, min_by(\"start\", (frame, \"start\")) first_start from o group by 1)"
ORACLES["g04_sequence_json"] = _profile_sql(f"""select p.seq_id, concat_ws(',', 'id,name,description,length,sequence_type,semantic_description,analysis', case when f.top > 0 then 'top_orfs' end, case when cpg_count > 0 then 'cpg_islands' end, 'sequence') keys,
  cast(p.seq_id as varchar) as name, round(gc_content, 6) gc, orf_count orfs, f.top, f.first_start, case when cpg_count > 0 then cpg_count end islands, md5(sequence) sequence_md5
from profile p join v_seq using (seq_id) left join (select seq_id, least(count(*), 5) top, min_by("start", frame * 1000000000 + "start") first_start from o group by 1) f on f.seq_id = p.seq_id""")

"""Names, run ids, checkpoint names and small parsers."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The domain codes of the two dataset families, and the spellings of Office-Home domains by code.
OFFICE_HOME = ("Ar", "Cl", "Pr", "Rw")
OFFICE_31 = ("A", "D", "W")
OFFICE_HOME_NAMES = {"art": "Ar", "clipart": "Cl", "product": "Pr", "realworld": "Rw", "real": "Rw"}
# The parts of a run id, short name by configuration key, in their order.
RUN_ID_KEYS = {
    "dataset": "ds",
    "split_mode": "split",
    "eval_split": "eval",
    "adapt_split": "adapt",
    "algorithm": "alg",
    "backbone": "bb",
    "seed": "seed",
    "pretrained": "pt",
    "replace_batchnorm_with_instancenorm": "in",
    "optimizer": "opt",
    "lr": "lr",
    "weight_decay": "wd",
    "batch_size": "bs",
    "grad_accum_steps": "ga",
    "epochs": "ep",
    "dann_penalty_weight": "dann",
    "grl_lambda": "grl",
    "dann_featurizer_lr_mult": "fmult",
    "dann_discriminator_lr_mult": "dmult",
    "coral_penalty_weight": "coral",
    "meiis_K": "K",
    "meiis_tau": "tau",
    "meiis_step": "iis",
    "meiis_damp": "damp",
    "meiis_ema": "ema",
}
# Fixed value: runs of characters that a run id replaces by one hyphen.
RUN_ID_UNSAFE = r"[^a-zA-Z0-9_.=\\-]+"


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for item in table.items() for x in item])[key]


def normalize_domain_code(raw: Column, codes: tuple[str, ...] = OFFICE_HOME, names: dict[str, str] | None = None, strict: bool = True) -> Column:
    """Canonical domain code of a code as it stands or of a name, in which case, spaces and underscores do not matter.

    Without ``names``, those of Office-Home hold for its codes and none for others. Unknown: an error, or null if not strict.
    """
    names = names if names is not None else OFFICE_HOME_NAMES if codes == OFFICE_HOME else {}
    found = F.when(raw.isin(*codes), raw)
    if names:
        found = found.otherwise(_lookup(F.translate(F.lower(raw), "_ ", ""), names))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown domain "), F.coalesce(raw, F.lit("null")))).cast("string")) if strict else found


def dataset_tag(name: Column) -> Column:
    """``office-home`` or ``office-31`` whatever the spelling, else the lower-cased name."""
    plain = F.translate(F.lower(name), "-_ ", "")
    return F.when(plain == "officehome", "office-home").when(plain == "office31", "office-31").otherwise(F.lower(name))


def transfer_label(src: Column, tgt: Column) -> Column:
    return F.concat(F.coalesce(src, F.lit("?")), F.lit("->"), F.coalesce(tgt, F.lit("?")))


def canonical_json(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def run_hash(doc: Column, length: int = 10, ignore: tuple[str, ...] = ()) -> Column:
    """First ``length`` hex digits of the SHA-1 of the canonical JSON (sorted keys, no spaces) of a JSON text.

    Built-in JSON functions keep key order and print floats otherwise, so the text is normalised in an Arrow batch.
    """

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical_json({k: v for k, v in json.loads(t).items() if k not in ignore}))

    return F.left(F.sha1(canonical(doc).cast("binary")), F.lit(length))


def _shown(value) -> str:
    if isinstance(value, bool):
        text = str(int(value))
    elif isinstance(value, float):
        text = f"{value:.6g}".replace("+", "") if value else "0"
    else:
        text = str(value)
    return re.sub(RUN_ID_UNSAFE, "-", text.strip().replace(" ", ""))


def run_id_of(config: dict) -> str:
    """``k=v`` parts in fixed order, floats with six significant digits, then a hash of the whole configuration.

    Settings that are missing or null have no part; spaces go, characters unsafe in a path become hyphens.
    """
    parts = [f"{short}={_shown(config[k])}" for k, short in RUN_ID_KEYS.items() if config.get(k) is not None]
    return "__".join([*parts, "h=" + hashlib.sha1(canonical_json(config).encode()).hexdigest()[:8]])


def encode_run_id(doc: Column) -> Column:
    """Column form of :func:`run_id_of` over JSON texts."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else run_id_of(json.loads(t)))

    return run(doc)


def decode_run_id(run_id: Column) -> Column:
    """Map of configuration key to text; parts without ``=`` are left out, unknown short names stay."""
    parts = F.filter(F.split(run_id, "__"), lambda p: F.instr(p, "=") > 0)
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.expr("1").cast("int").alias("i"), p.alias("p")))
    pairs = F.transform(entries, lambda e: F.struct(F.coalesce(_lookup(e["k"], {v: k for k, v in RUN_ID_KEYS.items()}), e["k"]).alias("key"), F.substring(e["p"], F.length(e["k"]) + 2, F.length(e["p"])).alias("value")))
    return F.map_from_entries(pairs)


def make_ckpt_name(method: Column, dataset: Column, src: Column, tgt: Column, seed: Column, epochs_source: Column, epochs_adapt: Column, batch: Column, adapted: dict[str, Column] | None = None, adapted_method: str = "me_iis") -> Column:
    """``method__dataset__src2tgt__seedN__EsrcA__EadB__bsC.pt``.

    Before ``.pt``, names of ``adapted_method`` have ``__layersL__gmmLO-HI__iisN-TOL``, from ``adapted`` (layers,
    gmm_min, gmm_max, iis_iters, iis_tol): layers are an array or a comma list and stand with hyphens; missing ones have the
    defaults 2, 8, 15 and 0.001. A tolerance is shown as its text.
    """
    tag = lambda name, *c: F.concat(F.lit(name), *[x.cast("string") for x in c])
    parts = [method, dataset, F.concat(src, F.lit("2"), tgt), tag("seed", seed), tag("Esrc", epochs_source), tag("Ead", epochs_adapt), tag("bs", batch)]
    name = F.concat_ws("__", *parts)
    if adapted is not None:
        given = lambda key, default: F.coalesce(adapted[key].cast("string"), F.lit(default)) if key in adapted else F.lit(default)
        dash = F.lit("-")
        layers = F.regexp_replace(F.regexp_replace(F.translate(adapted["layers"].cast("string"), "[]", ""), r"^[\s,]+|[\s,]+$", ""), r"\s*,[\s,]*", "-")
        suffix = F.concat_ws("__", tag("layers", layers), tag("gmm", given("gmm_min", "2"), dash, given("gmm_max", "8")), tag("iis", given("iis_iters", "15"), dash, given("iis_tol", "0.001")))
        name = F.when(method == adapted_method, F.concat_ws("__", name, suffix)).otherwise(name)
    return F.concat(name, F.lit(".pt"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def decode_ckpt_name(name: Column) -> Column:
    """Struct of the parts of a checkpoint name; ``error`` says that it has another form.

    Seed and numbers of the suffix are numbers, epochs and batch size texts. A path before the name goes; ``raw`` is
    the name without ``.pt``. The name is split once, and each part is looked for once.
    """
    raw = F.replace(F.element_at(F.split(name, "/"), -1), F.lit(".pt"), F.lit(""))
    bare = lambda c, tag: F.replace(c, F.lit(tag), F.lit(""))
    at = lambda parts, i: F.get(parts, F.lit(i))

    def split(x: Column) -> Column:
        parts, seed = x["parts"], bare(at(x["parts"], 3), "seed").try_cast("int")
        rest = F.slice(parts, 8, F.greatest(F.size(parts) - 7, F.lit(0)))
        whole = F.coalesce((F.size(parts) >= 7) & F.contains(at(parts, 2), F.lit("2")) & seed.isNotNull(), F.lit(False))
        return F.struct(x["raw"].alias("raw"), parts.alias("parts"), seed.alias("seed"), rest.alias("rest"), whole.alias("whole"))

    def suffix(x: Column) -> Column:
        payload = lambda tag: F.when(x["whole"], bare(F.try_element_at(F.filter(x["rest"], lambda t: t.startswith(tag)), F.lit(-1)), tag))
        return F.struct(x.alias("x"), *[payload(tag).alias(tag) for tag in ("layers", "gmm", "iis")])

    def decoded(y: Column) -> Column:
        x, gmm, iis = y["x"], y["gmm"], y["iis"]
        first = lambda c: F.when(F.contains(c, F.lit("-")), F.substring_index(c, "-", 1))
        behind = lambda c: F.when(F.contains(c, F.lit("-")), F.substring(c, F.instr(c, "-") + 1, F.length(c)))
        low, high = first(gmm).try_cast("int"), behind(gmm).try_cast("int")
        iters, tol = first(iis).try_cast("double").cast("int"), behind(iis).try_cast("double")
        wrong = (first(gmm).isNotNull() & (low.isNull() | high.isNull())) | (first(iis).isNotNull() & (iters.isNull() | tol.isNull()))
        keep = lambda c: F.when(x["whole"], c)
        pair, part = at(x["parts"], 2), lambda i: at(x["parts"], i)
        return F.struct(
            x["raw"].alias("raw"), keep(part(0)).alias("method"), keep(part(1)).alias("dataset"), keep(F.substring_index(pair, "2", 1)).alias("src"), keep(F.substring(pair, F.instr(pair, "2") + 1, F.length(pair))).alias("tgt"),
            keep(x["seed"]).alias("seed"), keep(bare(part(4), "Esrc")).alias("epochs_source"), keep(bare(part(5), "Ead")).alias("epochs_adapt"), keep(bare(part(6), "bs")).alias("batch_size"),
            y["layers"].alias("layers"), low.alias("gmm_min"), high.alias("gmm_max"), iters.alias("iis_iters"), tol.alias("iis_tol"),
            F.when(~x["whole"] | F.coalesce(wrong, F.lit(False)), "unable to decode").alias("error"),
        )

    named = _once(raw, lambda r: F.struct(r.alias("raw"), F.split(r, "__").alias("parts")))
    return _once(_once(_once(named, split), suffix), decoded)


def parse_layers(text: Column) -> Column:
    """Array of layer names of a comma list; a blank list is an error."""
    names = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(names) > 0, names).otherwise(F.raise_error(F.lit("no layer named")).cast("array<string>"))


def components_map(layers: Column, default: int, override: Column | None = None) -> Column:
    """Map of layer to number of components from ``l3:10,l4:5`` or ``5,10`` or nothing.

    Unknown layers, counts of 0 or less and lists of another length are errors.
    """
    base = F.map_from_entries(F.transform(layers, lambda name: F.struct(name, F.lit(default))))
    if override is None:
        return base
    error = lambda text: F.raise_error(F.lit(text)).cast("map<string,int>")
    items = parse_layers(override)
    named = F.map_from_entries(F.transform(items, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)), F.trim(F.substring_index(s, ":", -1)).cast("int"))))
    listed = F.map_from_arrays(layers, F.transform(items, lambda s: s.cast("int")))
    positive = lambda m: ~F.exists(F.map_values(m), lambda n: n <= 0)
    by_name = F.when(F.size(F.array_except(F.map_keys(named), layers)) > 0, error("unknown layer")).when(positive(named), F.map_from_entries(F.transform(layers, lambda name: F.struct(name, F.coalesce(named[name], F.lit(default)))))).otherwise(error("count must be positive"))
    by_list = F.when(F.size(items) != F.size(layers), error("one count for each layer")).when(positive(listed), listed).otherwise(error("count must be positive"))
    return F.when(F.trim(F.coalesce(override, F.lit(""))) == "", base).when(F.instr(override, ":") > 0, by_name).otherwise(by_list)


def run_status(has_metrics: Column, completed: Column, has_state: Column, dir_exists: Column, stderr_tail: Column) -> Column:
    """OK with metrics; else FAILED with error output, MISSING_METRICS if completed, INCOMPLETE if begun, NOT RUN."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(yes(has_metrics), "OK").when(F.trim(F.coalesce(stderr_tail, F.lit(""))) != "", "FAILED").when(yes(completed), "MISSING_METRICS")
        .when(yes(has_state) | yes(dir_exists), "INCOMPLETE").otherwise("NOT RUN")
    )

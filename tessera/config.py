"""Settings of the resolution pipeline; every field is a command-line flag of ``tessera.plans.cli``."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # Names and defaults of the settings.
    # paths and seed
    data_dir: str = "dataset"
    out_dir: str = "output"
    model_dir: str = "models"
    seed: int = 42
    # sampling
    train_s1_frac: float = 0.4
    val_frac: float = 0.2
    val_max: int = 50_000
    folds: int = 3
    # blocking
    knn_k: int = 25
    knn_k_name: int = 15
    knn_k_addr: int = 15
    knn_min: float = 1e-6
    knn_min_name: float = 0.25
    knn_min_addr: float = 0.25
    w_name: float = 0.6
    knn_max_df: float = 0.005
    knn_df_floor: int = 20
    key_cap_s1: int = 200
    key_cap_q: int = 2000
    min_key_len: int = 4
    keys: tuple[str, ...] = ("k_skel", "k_name_sort", "k_name_clean", "k_hn_st", "k_st2", "k_nm_st", "k_nm_hn", "k_post_nm", "k_post_ra1", "k_first_hn")
    # policy
    prune_recall: float = 0.999
    safety_net: bool = True
    safe_cos_name: float = 0.5
    safe_cos_all: float = 0.7
    noise_floor: float = 0.2
    keep_q: int = 0
    keep_s: int = 0
    # models
    trees: int = 60
    depth: int = 5
    learning_rate: float = 0.1
    bags: int = 1
    early_stop: bool = True
    by_country: bool = False
    cache: bool = False
    # second scorers
    use_emb: bool = False
    use_ce: bool = False
    ce_train_pairs: int = 400_000
    ce_margin: float = 3.0
    ce_max_rows: int = 4_000_000

    def parse(self, args: list[str]) -> Config:
        """This configuration with the flags of a command line."""
        parser = argparse.ArgumentParser()
        for f in fields(self):
            now = getattr(self, f.name)
            if isinstance(now, bool):
                kind = lambda x: x.lower() in ("1", "true", "yes")
            elif isinstance(now, tuple):
                kind = lambda x: tuple(x.split(","))
            else:
                kind = type(now)
            parser.add_argument(f"--{f.name.replace('_', '-')}", type=kind, default=now)
        return replace(self, **vars(parser.parse_args(args)))


#: The current rules, and the earlier ones: one vector channel, six keys, no noise floor and no safety net.
CURRENT = Config()
EARLIER = replace(CURRENT, knn_k=20, knn_k_name=0, knn_k_addr=0, key_cap_s1=100, key_cap_q=1000, train_s1_frac=0.3, prune_recall=0.998, safety_net=False, noise_floor=0.0, keys=("k_skel", "k_hn_st", "k_st2", "k_nm_st", "k_nm_hn", "k_post_nm"))

"""The contract of a fine-tuning step: the texts it reads, a dry run, and the document it leaves. Training itself is not done here."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame

from voxmend.operators.exports import training_texts


@dataclass(frozen=True)
class Settings:
    """Options of a fine-tuning step. The defaults."""

    model_name_or_path: str
    train_file: str = ""
    eval_file: str = ""
    input_format: str = "qwen-messages"
    max_length: int = 2048
    epochs: float = 1.0
    learning_rate: float = 2e-4
    per_device_train_batch_size: int = 1
    per_device_eval_batch_size: int = 1
    gradient_accumulation_steps: int = 16
    warmup_ratio: float = 0.03
    logging_steps: int = 10
    save_steps: int = 500
    eval_steps: int = 500
    lora_r: int = 16
    lora_alpha: int = 32
    lora_dropout: float = 0.05
    target_modules: str = "q_proj,k_proj,v_proj,o_proj,gate_proj,up_proj,down_proj"
    qlora: bool = False
    bf16: bool = False
    fp16: bool = False
    gradient_checkpointing: bool = False


def dry_run(settings: Settings, train: DataFrame, evaluation: DataFrame | None = None) -> dict:
    """train_rows, eval_rows, and a sample of the first training text: what training would read, formatted."""
    texts = training_texts(train, settings.input_format, settings.max_length)
    return {"train_rows": texts.count(), "eval_rows": 0 if evaluation is None else training_texts(evaluation, settings.input_format, settings.max_length).count(), "sample": [{"text": r["text"]} for r in texts.take(1)]}


def metadata(settings: Settings, train_rows: int, eval_rows: int) -> dict:
    """The document of a training run: its settings, adapter and precision grouped, and how many rows it read."""
    said = asdict(settings)
    adapter = {"r": said.pop("lora_r"), "alpha": said.pop("lora_alpha"), "dropout": said.pop("lora_dropout"), "target_modules": [m.strip() for m in said.pop("target_modules").split(",") if m.strip()], "qlora": said.pop("qlora")}
    precision = {k: said.pop(k) for k in ("bf16", "fp16")}
    return {"created_at": datetime.now(timezone.utc).isoformat(), **said, "train_rows": int(train_rows), "eval_rows": int(eval_rows), "lora": adapter, "precision": precision}


def write_metadata(settings: Settings, train_rows: int, eval_rows: int, folder: str) -> str:
    """Writes training_metadata.json into folder; returns its path."""
    path = Path(folder) / "training_metadata.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(metadata(settings, train_rows, eval_rows), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return str(path)

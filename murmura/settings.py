"""Parameters of the operators, validated once and passed explicitly."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

#: What may be embedded, classified and vectorized.
TEXT_EMBEDDING_FIELDS = ("caption", "text", "attachment.transcription")
IMAGE_ATTACHMENT_TYPES = ("photo",)
CLASSIFICATION_FIELDS = ("text", "caption")
#: Names of public speech models.
ASR_MODELS = (
    "tiny", "tiny.en", "base", "base.en", "small", "small.en", "medium", "medium.en", "large", "large-v1", "large-v2", "large-v3",
    "distil-large-v2", "distil-medium.en", "distil-small.en", "distil-large-v3", "turbo", "large-v3-turbo",
)
#: Public image models and the length of their vectors.
IMAGE_MODELS = {
    "openai/clip-vit-base-patch16": 512,
    "openai/clip-vit-base-patch32": 512,
    "openai/clip-vit-large-patch14": 768,
    "openai/clip-vit-large-patch14-336": 768,
}


@dataclass(frozen=True)
class Settings:
    """Defaults of all pipelines; an invalid combination cannot be built."""

    classification_fields: tuple[str, ...] = CLASSIFICATION_FIELDS
    classification_min_length: int = 50
    classification_batch: int = 265
    classification_languages: tuple[str, ...] = ("de",)
    classification_interval_min: int = 120
    asr_model: str = "medium"
    asr_vad_filter: bool = True
    asr_attachment_types: tuple[str, ...] = ("audio", "voice")
    asr_concurrency: int = 1
    asr_batch: int = 100
    asr_interval_min: int = 60
    text_model: str = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"
    text_dimension: int = 384
    text_embedding_fields: tuple[str, ...] = ("text", "caption")
    text_batch: int = 256
    text_model_batch: int = 32
    text_interval_min: int = 30
    image_model: str = "openai/clip-vit-base-patch16"
    image_dimension: int = 512
    image_attachment_types: tuple[str, ...] = IMAGE_ATTACHMENT_TYPES
    image_batch: int = 128
    image_model_batch: int = 4
    image_interval_min: int = 30
    storage_provider: str = "s3-compatible"
    storage_region: str | None = None
    storage_use_ssl: bool = False
    storage_endpoint: str = "minio:9000"
    storage_bucket_prefix: str = ""
    model_download_allowed: bool = True
    use_gpu: bool = False
    gpu_device: int = 0

    def __post_init__(self) -> None:
        for name, allowed in (("text_embedding_fields", TEXT_EMBEDDING_FIELDS), ("classification_fields", CLASSIFICATION_FIELDS), ("image_attachment_types", IMAGE_ATTACHMENT_TYPES)):
            if wrong := [v for v in getattr(self, name) if v not in allowed]:
                raise ValueError(f"{name}: not allowed: {', '.join(wrong)}")
        if self.asr_model not in ASR_MODELS:
            raise ValueError(f"asr_model: unknown: {self.asr_model}")
        if self.image_model not in IMAGE_MODELS:
            raise ValueError(f"image_model: unknown: {self.image_model}")
        if self.storage_provider not in ("aws", "s3-compatible"):
            raise ValueError(f"storage_provider: unknown: {self.storage_provider}")
        if self.storage_provider == "aws" and not self.storage_region:
            raise ValueError("storage_region is needed for the provider aws")
        # A known model determines the length of its vectors, whatever was given.
        object.__setattr__(self, "image_dimension", IMAGE_MODELS[self.image_model])

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Settings from variables named as the fields, in capitals; lists are comma-separated."""
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            if (raw := env.get(f.name.upper())) is None:
                continue
            kind = type(f.default)
            if kind is bool:
                if raw.lower() not in ("1", "0", "true", "false", "yes", "no", "on", "off"):
                    raise ValueError(f"{f.name}: not a truth value: {raw}")
                given[f.name] = raw.lower() in ("1", "true", "yes", "on")
            elif kind is tuple:
                given[f.name] = tuple(x.strip() for x in raw.strip("[]").replace('"', "").split(",") if x.strip())
            else:
                given[f.name] = int(raw) if kind is int else raw
        return cls(**given)

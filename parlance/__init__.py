"""parlance — Spark-native jobs for the data work around a chat language model.

Request gating and moderation, prompt templating and thread rebuilding,
corpus tokenization and sampling, language-model scoring, and quantization of
vector tables, all as DataFrame plans (``DataFrame -> DataFrame`` functions
usable with ``df.transform``) and ``Column -> Column`` helpers.
"""

__all__ = ["session", "constants"]

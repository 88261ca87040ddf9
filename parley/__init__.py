"""A chat-archive analytics engine made of PySpark DataFrame operators."""

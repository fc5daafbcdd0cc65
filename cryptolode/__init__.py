"""Cryptography-inventory analytics on Spark."""

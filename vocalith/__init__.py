"""Vocalith: bioacoustic and text-corpus analytics written for Spark."""

"""Behavioural risk analytics over assessment event streams, as Spark DataFrame operators."""

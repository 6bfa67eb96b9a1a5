"""Waymesh: timetable, journey and corpus analytics expressed as Spark plans."""

"""Scans: landed pages, source catalogues, feed XML, JSON lists, snapshots."""

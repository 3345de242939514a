"""Scans of source trees and of stored tables."""

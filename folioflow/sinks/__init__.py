"""Writers: documents out of HTML, drafts, quarantine."""

"""From folders of volumes to one report."""

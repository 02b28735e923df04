"""Reports over lines and parts."""
